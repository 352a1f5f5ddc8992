"""Texts that were cut off: hidden storage limits exposed by recomputed lengths, then an inspection of the endings.

Every text's length is recomputed as other systems would have counted it (characters, UTF-8 bytes, UTF-16 units, with
entities escaped, as a JSON string, with CRLF line ends). Grouped by source, encoding and length, a storage limit shows as a
length that far more texts have than the lengths around it. A text at a limit of its source is cut unless its ending is
whole. Then the endings of the other texts are read: some are whole by their form (an
end of a sentence, a closed table row or block), some are broken by their form (half an entity, a lone replacement
character), and the rest is judged by what the whole corpus does: a signature, a list item, a file name or a
closing phrase that many texts end with is whole, one that hardly any other text has is a fragment.
Copies of a text are one witness, and no text is a witness of its own ending.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skarn.runtime import broadcast_if_small, checkpointed, need

#: A form is common for a text if this share of all different texts, and at least LEAST of them, have it besides that text.
SHARE, LEAST = 0.0005, 3
#: A length is a limit if at least this many texts of its source have it, and this many times as many as the lengths around it.
SPIKE, STEEP, AROUND, LOWEST = 6, 12.0, 40, 100
#: Ways to count a length, in the order of ``lengths``.
ENCODINGS = ("chars", "utf8", "utf16", "html", "html_utf8", "json", "json_ascii", "crlf", "crlf_utf8")

CLOSERS = "\"'”’»)\\]}」』）*_"
SENTENCE_END = re.compile(rf"[.!?。！？][{CLOSERS}]*$")
ELLIPSIS = re.compile(r"\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\))$")
#: Half an entity, tag or escape at the very end.
BROKEN = re.compile(r"(?:&(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{2,7})|<[/!]?[a-zA-Z][^<>\n]{0,60}|<[/!]?|\\u[0-9a-fA-F]{0,3}|%[0-9A-F]?|\ufffd+)$")
HALF_ADDRESS = re.compile(r"(?<![\w.])\d{1,3}(?:(?:\[\.\]|\.)\d{1,3}){1,2}(?:\[?\.?\]?)$")
ADDRESS = re.compile(r"^\d{1,3}(?:(?:\[\.\]|\.)\d{1,3}){3}(?::\d+)?$")
HEX = re.compile(r"^[0-9a-fA-F]{8,}$")
#: Digits of the usual digests.
DIGESTS = {32, 40, 56, 64, 96, 128}
BULLET = re.compile(r"^(?:[-*•–·]|\[?\d{1,3}[\].)])\s+")
NAME = re.compile(r"(?:[/\\]|\[?\.\]?)([A-Za-z]+\d*)$")
INNER = re.compile(r"[/\\.\]]([A-Za-z]+\d*)(?=[,;:]?\s)")
WORD_END = re.compile(r"\b([^\W\d_]+)[.!?。！？](?=\s|$)")
DIGITS = re.compile(r"\d+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
CONTROL = re.compile(r"[\x00-\x1f]")


def lengths(t: str) -> list[int]:
    """The lengths of a text in the order of ENCODINGS."""
    n = len(t)
    lines = t.count("\n") - t.count("\r\n")
    amp, lt, gt, dq, sq, bs = (t.count(c) for c in "&<>\"'\\")
    html = 4 * amp + 3 * (lt + gt) + 5 * (dq + sq)
    control = CONTROL.findall(t)
    short = sum(c in "\n\r\t\b\f" for c in control)
    json_extra = dq + bs + short + 5 * (len(control) - short)
    if t.isascii():
        utf8 = utf16 = n
        ascii_extra = 0
    else:
        utf8 = len(t.encode("utf-8", "surrogatepass"))
        foreign = "".join(NON_ASCII.findall(t))
        astral = sum(c > "\uffff" for c in foreign)
        utf16 = n + astral
        ascii_extra = 5 * len(foreign) + 6 * astral
    return [n, utf8, utf16, n + html, utf8 + html, n + json_extra, n + json_extra + ascii_extra, n + lines, utf8 + lines]


def name_form(token: str) -> str | None:
    """The last part of a path, URL, host or key with its digits masked; null for other tokens."""
    m = NAME.search(token.rstrip(",;:"))
    return DIGITS.sub("#", m.group(1)) if m else None


def line_form(line: str) -> str | None:
    """The frame of a signature, list item or labelled line: its first and last token; null for prose."""
    if len(line) > 120:
        return None  # prose; a frame is a short line
    parts = line.split()
    if 2 <= len(parts) <= 12 and (not parts[0][0].isalnum() or parts[0].endswith(":")):
        return f"{parts[0]} {parts[-1]}"
    return None


def ending(t: str) -> tuple[str, str | None]:
    """How a text ends: ``blank``, ``whole``, ``broken``, ``open`` or a form to look up, with its key.

    Forms: ``ellipsis`` (the phrase before it), ``name`` (the last part of a path or host), ``line`` (its frame),
    ``tag`` (the last word of a list of tags), ``value`` (an address or a number: whole, unless at a limit).
    """
    s = t.rstrip()
    if not s.strip("\ufeff\u200b\u200c\u200d \t\r\n"):
        return "blank", None
    tail = s[-200:]  # longer than anything the patterns of the very end can match
    if BROKEN.search(tail):
        return "broken", None
    if m := ELLIPSIS.search(tail):
        phrase = re.split(r"[.!?。！？]\s+|\n", tail[: m.start()])[-1].strip()
        return "ellipsis", phrase[-80:]
    last = s[s.rfind("\n") + 1 :].strip()
    if HALF_ADDRESS.search(tail) and not ADDRESS.match(last.rsplit(None, 1)[-1].strip("|")):
        return "open", None
    if SENTENCE_END.search(tail):
        if s.endswith("}") and s.count("{") > s.count("}"):
            return "open", None
        token = last.rsplit(None, 1)[-1][:-1]
        if s[-1] == "." and ("://" in token or "\\" in token or token.startswith("/")) and (form := name_form(token)) is not None:
            return "name", form  # a period inside a path or host, or after a whole one
        return "whole", None
    if last.startswith("|"):
        rows = [x.strip() for x in s.split("\n")[-3:]]
        ruled = any(set(x) <= set("|-: ") for x in rows[:-1])
        same = len(rows) > 1 and rows[-2].count("|") == last.count("|")
        return ("whole" if last.endswith("|") and same and (ruled or len(rows) < 3 or rows[-3].startswith("|")) and not set(last) <= set("|-: ") else "open"), None
    if last.endswith("}"):
        return ("whole" if s.count("{") <= s.count("}") else "open"), None
    bare = BULLET.sub("", last)
    token = bare.rsplit(None, 1)[-1] if bare else ""
    alone = bare == token or (bare.count(" ") == 1 and bare.split()[0].endswith(":"))
    if alone and token:
        if HEX.match(token):
            return ("whole" if len(token) in DIGESTS else "open"), None
        if ADDRESS.match(token):
            return "value", None
        if (form := name_form(token)) is not None:
            return ("name", form) if not form.endswith("#") else ("key", form)
    if (form := line_form(last)) is not None:
        if "," in last:
            return "tag", last.split()[-1].lower()
        return "line", form
    return "open", None


def evidence(t: str, end: str | None) -> tuple[set[str], bool]:
    """The forms of a text that other texts' endings are compared with, and whether it has its own, ``end``, only at its end."""
    s = t.rstrip()
    own = {f"name {DIGITS.sub('#', x)}" for x in set(INNER.findall(t))}
    own.update(f"word {w}" for w in {x.lower() for x in set(WORD_END.findall(t))})
    for line in s.split("\n")[:-1]:
        if (form := line_form(line)) is not None:
            own.add(f"line {form}")
    only = end is not None and end not in own
    if only:
        own.add(end)
    return own, only


#: ``n``: of a form, the different texts that have it; of a text, how many of them are the text itself by its ending alone.
#: ``first``, ``in_source``: the text is the first of its copies, in all and in its source.
_SCHEMA = "doc_id bigint, source string, kind string, form string, lens array<int>, n bigint, first boolean, in_source boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    names = ["doc_id", "source", "kind", "form", "lens", "n", "first", "in_source"]

    def forms() -> pa.RecordBatch:
        k = list(seen)
        void = [None] * len(k)
        return pa.RecordBatch.from_arrays([pa.array(void, pa.int64()), pa.array(void, pa.string()), pa.array(void, pa.string()), pa.array(k, pa.string()), pa.array(void, pa.list_(pa.int32())), pa.array([seen[x] for x in k], pa.int64()), pa.array(void, pa.bool_()), pa.array(void, pa.bool_())], names=names)

    for b in batches:
        ids, sources, texts = b.column(0), b.column(1), b.column(2).to_pylist()
        kinds, keys, lens, selves = [], [], [], []
        for t, first in zip(texts, b.column(3).to_pylist(), strict=True):
            kind, key = ending(t)
            if kind in ("name", "key"):
                key = f"name {key}"
            elif key is not None:
                key = f"{kind} {key}"
            kinds.append(kind)
            keys.append(key)
            lens.append(lengths(t))
            alone = False
            if kind != "blank" and (first or key is not None):
                own, alone = evidence(t, key)
                if first:
                    seen.update(own)
            selves.append(int(alone))
        yield pa.RecordBatch.from_arrays([ids, sources, pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(lens, pa.list_(pa.int32())), pa.array(selves, pa.int64()), b.column(3), b.column(4)], names=names)
        if len(seen) > 200_000:
            yield forms()
            seen.clear()
    yield forms()


def readings(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """One row per text (``doc_id, source, kind, form, lens``) and pre-aggregated rows of forms (``form, n``, no id); written once."""
    need(df, id_col, text, source)
    rows = df.select(F.col(id_col).cast("bigint"), F.col(source).cast("string"), F.col(text)).where(F.col(text).isNotNull())
    rows = rows.toDF("doc_id", "source", "text")
    # Copies are found by 128 bits; only ids are grouped, and the flags come back by id, so that a text with many copies isn't one task's.
    each = rows.groupBy("source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")).agg(F.min("doc_id").alias("id"))
    flags = each.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.collect_list("id").alias("ids")).select("least", F.explode("ids").alias("id")).select("id", (F.col("id") == F.col("least")).alias("f"))
    marked = rows.join(flags, F.col("doc_id") == F.col("id"), "left").select("doc_id", "source", "text", F.coalesce("f", F.lit(False)).alias("first"), F.col("f").isNotNull().alias("in_source"))
    return checkpointed(marked.mapInArrow(_read, _SCHEMA))


def storage_limits(read: DataFrame, different: bool = False) -> DataFrame:
    """``source, encoding, e, length, texts``: the lengths at which a source's texts pile up; copies count once if ``different``.

    A limit shows in several encodings of the same texts, so each text stands for the largest of the piles it is in (the first
    encoding of equal ones); a pile that at least SPIKE texts stand for is a limit. A source may have several, in any
    encodings. Lengths below LOWEST are no limits: short texts recur. Computed when called; a small table.
    """
    one = read.where("doc_id IS NOT NULL AND kind <> 'blank'").where(F.col("in_source") | F.lit(not different))
    long = one.select("doc_id", "source", F.posexplode("lens").alias("e", "length")).where(F.col("length") >= LOWEST)
    each = one.select("source", F.posexplode("lens").alias("e", "length")).groupBy("source", "e", "length").agg(F.count(F.lit(1)).alias("texts"))
    by = W.partitionBy("source", "e").orderBy("length")
    near = F.sum("texts").over(by.rangeBetween(-AROUND, AROUND)) - F.sum("texts").over(by.rangeBetween(-2, 2))
    piles = each.withColumn("near", near).where((F.col("length") >= LOWEST) & (F.col("texts") >= SPIKE) & (F.col("texts") > STEEP * (F.col("near") + 1) / (2 * AROUND - 4)))
    piles = broadcast_if_small(piles.select(F.col("source").alias("p_source"), F.col("e").alias("p_e"), F.col("length").alias("p_length"), "texts"))
    met = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("e") == F.col("p_e")) & (F.col("length") == F.col("p_length"))
    main = long.join(piles, met).groupBy("doc_id").agg(F.min_by(F.struct("source", "e", "length", "texts"), F.struct(-F.col("texts"), "e")).alias("x"))
    names = F.array(*[F.lit(x) for x in ENCODINGS])
    kept = main.groupBy("x.source", "x.e", "x.length", "x.texts").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") >= SPIKE)
    return checkpointed(kept.select("source", F.get(names, F.col("e")).alias("encoding"), "e", "length", "texts"))


def judged(read: DataFrame) -> DataFrame:
    """``doc_id, source, kind, at_limit, cut, step`` of every text that isn't null; ``step`` says what decided.

    First the limits: a text that sits exactly at a limit of its source is cut unless its ending is whole by its form (``limit``).
    Then the endings of the others: whole, open or broken by their form (``ending``), or a form that other texts
    end with or hold, or don't (``corpus``). Blank texts are never cut (``blank``).
    """
    docs = read.where("doc_id IS NOT NULL")
    limits = broadcast_if_small(storage_limits(read, different=True).select(F.col("source").alias("l_source"), "e", "length"))
    met = F.col("source").eqNullSafe(F.col("l_source")) & (F.col("d_e") == F.col("e")) & (F.col("d_length") == F.col("length"))
    sizes = docs.where("kind <> 'blank'").select("doc_id", "source", F.posexplode("lens").alias("d_e", "d_length")).where(F.col("d_length") >= LOWEST)
    at = sizes.join(limits, met, "left_semi").select("doc_id").distinct().withColumn("at_limit", F.lit(True))
    placed = docs.join(at, "doc_id", "left").select("doc_id", "source", "kind", "form", "n", F.coalesce("at_limit", F.lit(False)).alias("at_limit"))
    placed = checkpointed(placed)
    # Only endings with a form need the corpus; the others aren't joined, so that they don't meet as null keys in one task.
    clear = F.col("form").isNull() | (F.col("at_limit") & (F.col("kind") != "whole"))
    hit = F.col("at_limit") & ~F.col("kind").isin("whole", "blank")
    step = F.when(F.col("kind") == "blank", "blank").when(hit, "limit").otherwise("ending")
    plain = placed.where(clear).select("doc_id", "source", "kind", "at_limit", (hit | F.col("kind").isin("open", "broken")).alias("cut"), step.alias("step"))
    total = read.where("doc_id IS NOT NULL AND first").agg(F.greatest(F.lit(LEAST), F.ceil(F.count(F.lit(1)) * F.lit(SHARE))).alias("common"))
    forms = read.where("doc_id IS NULL").groupBy("form").agg(F.sum("n").alias("seen"))
    words = forms.where(F.col("form").startswith("word ")).select(F.concat(F.lit("tag "), F.substring("form", 6, 1 << 20)).alias("form"), F.col("seen").alias("as_word"))
    asked = placed.where(~clear)
    known = asked.select("form").distinct().join(forms, "form", "left").join(words, "form", "left").select("form", (F.coalesce("seen", F.lit(0)) + F.coalesce("as_word", F.lit(0))).alias("seen"))
    common = F.coalesce("seen", F.lit(0)) - F.col("n") >= F.col("common")
    out = asked.join(known, "form", "left").crossJoin(F.broadcast(total))
    return plain.unionByName(out.select("doc_id", "source", "kind", "at_limit", (~common).alias("cut"), F.lit("corpus").alias("step")))
