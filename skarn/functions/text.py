"""Text cleaning and splitting as column expressions; all of them stay in the JVM.

Null text gives null (or an empty array where said); texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_lines(t: Column) -> Column:
    """Strip blanks and tabs of each line and collapse blank lines to one line end."""
    lines = F.transform(F.split(F.regexp_replace(t, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def add_punctuation(t: Column, end: str = ".", closed: str = ",.?!:;") -> Column:
    """Close a text with ``end`` unless it already ends in a punctuation of ``closed``; trailing blanks go only when closing."""
    shut = (F.length(t) > 0) & F.lit(closed).contains(F.right(t, F.lit(1)))
    return F.when(shut, t).otherwise(F.concat(F.regexp_replace(t, r"[ \t\r\n]+$", ""), F.lit(end)))


def split_paragraphs(t: Column) -> Column:
    """Paragraphs between blank lines; empty ones are dropped."""
    return F.filter(F.split(t, r"\n[ \t]*\n[ \t\n]*"), lambda p: p != "")


def split_breaks(t: Column) -> Column:
    """Parts between two or more line ends; empty ones are dropped."""
    return F.filter(F.split(t, r"\n{2,}"), lambda p: p != "")


def close_paragraphs(t: Column) -> Column:
    """Close each paragraph with a period unless it ends in punctuation, a quote or a bracket; joined by blank lines."""
    shut = F.transform(F.split(t, r"\n[ \t]*\n[ \t\n]*"), lambda p: F.when(p.rlike(r"[.,?!:;'\"()\[\]{}]\z"), p).otherwise(F.concat(p, F.lit("."))))
    return F.array_join(shut, "\n\n")


def clear_text(t: Column) -> Column:
    """Lower-case, drop escaped control marks, collapse white space, blank hex runs, ASCII only."""
    c = F.lower(t)
    for mark, to in (("\\n", "\n"), ("\\t", " "), ("\\r", " "), ("\t", " ")):
        c = F.replace(c, F.lit(mark), F.lit(to))
    c = F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))
    c = F.regexp_replace(c, r"(\\*x[0-9a-f]{2}){2,}", " ")
    c = F.replace(c, F.lit("windows nt"), F.lit("windowsnt"))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def sentences_by_period(t: Column) -> Column:
    """Line ends become blanks, then a split at a period and a blank."""
    return F.split(F.replace(t, F.lit("\n"), F.lit(" ")), r"\. ")


def sentences_by_rule(t: Column) -> Column:
    """Collapse line ends, tabs to blanks, then a split after ``.``, ``!`` or ``?`` before a blank and at line ends."""
    c = F.replace(F.regexp_replace(t, r"\n+", "\n"), F.lit("\t"), F.lit(" "))
    marked = F.regexp_replace(c, r"([.!?]) +", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: F.replace(s, F.lit(" "), F.lit("")) != "")


def char_chunks(t: Column, size: int = 500, overlap: int = 20) -> Column:
    """Overlapping pieces ``start, chunk`` of ``size`` characters; none for texts of at most ``overlap`` characters."""
    last = F.length(t) - overlap - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(t, i + 1, F.lit(size)).alias("chunk")))


def words(t: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != "")


def token_chunks(tokens: Column, size: int) -> Column:
    """Slices of at most ``size`` tokens, in order."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, F.lit(size)))


def markdown_text(t: Column) -> Column:
    """Markdown to plain text, cut at the first citation mark."""
    c = F.substring_index(t, "(Citation:", 1)
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(#{1,6}[ \t]+|[-*+][ \t]+|>[ \t]*)", "")
    return F.trim(F.regexp_replace(c, r"(\*\*|__|`|\*)", ""))


def drop_references(t: Column) -> Column:
    """Without reference marks such as ``[12]``."""
    return F.regexp_replace(t, r"\[[0-9]+\]+", "")


def unquote(t: Column) -> Column:
    """Without one surrounding pair of quotes (either side on its own is stripped too)."""
    return F.regexp_replace(t, "^[\"']|[\"']$", "")


def strip_title(t: Column) -> Column:
    """A title with entities decoded, lower-cased, without punctuation but ``&``."""
    c = t
    # The entities that occur in bibliographic exports.
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(F.lower(c), "!\"#$%'()*+,-./:;<=>?@[\\]^_`{|}~", "")


def html_title(html: Column) -> Column:
    """The content of the first title element."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
