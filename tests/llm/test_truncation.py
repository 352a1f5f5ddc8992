import pytest

from skarn.llm import truncation as tr


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Done.", "whole"), ("“Done.”", "whole"), ("完了。", "whole"), ("Why now?", "whole"), ("x. .", "whole"), ("rule a {\n  b\n}", "whole"), ("rule a {\n  b", "open"),
        ("ends in the mid", "open"), ("a comma,", "open"), ("over &quo", "broken"), ('see <a href="htt', "broken"), ("bad �", "broken"), ("at 203.0.113.", "open"), ("\n203.0.1", "open"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"), ("| a | b |\n|---|---|\n| 1 | 2", "open"), ("| a | b |\n|---|---|\n| 1 |", "open"), ("| a | b |\n|---|---|", "open"),
        ("SHA-256: " + "a1" * 32, "whole"), ("- " + "a1" * 20, "whole"), ("- " + "a1" * 19, "open"), ("x\n203.0.113.9", "value"), ("x\n-- A desk", "line"), ("Tags: a, b, c", "tag"),
        ("Refs\n[1] https://a.example/x.html", "name"), ("k\nHKCU\\Run7", "key"), ("at http://abc.", "name"), ("at c:\\x\\y.dll.", "name"), ("and/or.", "whole"), ("so it was...", "ellipsis"), ("so it w [...]", "ellipsis"), ("cut…", "ellipsis"), ("", "blank"), (" \t\n", "blank"),
    ],
)
def test_endings(text, kind):
    assert tr.ending(text)[0] == kind


def test_lengths():
    import html
    import json

    for t in ("", "abc", "a\nb\r\nc\t\"'<>&\\", "é日𝒶\x01\n", "x" * 10):
        n = dict(zip(tr.ENCODINGS, tr.lengths(t), strict=True))
        crlf = t.replace("\r\n", "\n").replace("\n", "\r\n")
        assert n == {
            "chars": len(t), "utf8": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "html": len(html.escape(t).replace("&#x27;", "&apos;")), "html_utf8": len(html.escape(t).encode()),
            "json": len(json.dumps(t, ensure_ascii=False)) - 2, "json_ascii": len(json.dumps(t)) - 2, "crlf": len(crlf), "crlf_utf8": len(crlf.encode()),
        }


def corpus():
    rows = []
    for i in range(600):
        s = "The group copied files at the port authorities. " * (5 + i % 40)
        if i % 3 == 0:
            s = s[:500]
            src = "limited"
        else:
            src = None if i % 50 == 1 else f"s{i % 4}"
        if i % 3 == 1 and i % 2:
            s += "\n-- Alpha research desk"
        if i % 30 == 2:
            s += "Or so it seemed..."
        if i % 60 == 4:
            s += f"Then number {i} of the gro..."
        rows.append((i, s, src))
    return [*rows, (9000, None, "s1"), (9001, "", "s1"), (9002, " \n", None), (9003, "word", None), (9004, "Fine.", "s1")]


def test_corpus(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, source string").selectExpr("*", "1 AS kind", "2 AS n")
    read = tr.readings(df, "doc_id", "text", "source")
    limits = {(r["source"], r["length"]) for r in tr.storage_limits(read).collect()}
    assert ("limited", 500) in limits
    cut = {r["doc_id"] for r in tr.judged(read).where("cut").collect()}
    want = set()
    for i, s, _ in corpus():
        if s and s.strip() and not s.rstrip().endswith((".", "desk")):
            want.add(i)
        if s and s.endswith("gro..."):
            want.add(i)
    assert cut == want
    assert tr.judged(read).count() == len(corpus()) - 1


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert tr.judged(tr.readings(df, "doc_id", "text", "source")).count() == 0
    for t in ("/" * 200_000, "a" * 300_000, "<" * 100_000, "1." * 100_000, "{" * 100_000):
        tr.ending(t)
        tr.lengths(t)


def test_copies_of_a_cut_text_are_no_evidence(spark):
    body = "The group copied files at the port authorities. "
    rows = [(i, body * (5 + i), "s1") for i in range(30)]
    rows += [(100 + i, body * 3 + "\nSee\nhttps://a.example/downl", f"s{i % 2}") for i in range(10)]
    rows += [(200 + i, body * (3 + i) + "\n-- Alpha research desk", "s2") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    read = tr.readings(df, "doc_id", "text", "source")
    assert {r["doc_id"] for r in tr.judged(read).where("cut").collect()} == set(range(100, 110))
    assert tr.storage_limits(read, different=True).count() == 0


def test_a_limit_decides_for_common_endings(spark):
    body = "The group copied files at the port authorities. "
    end = "\n-- Alpha research desk"
    rows = [(i, f"{i:03d} " + "x" * (473 - len(body)) + " " + body + end, "limited") for i in range(20)]
    rows += [(100 + i, body * (3 + i) + end, "s2") for i in range(20)]
    size = len(rows[0][1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    read = tr.readings(df, "doc_id", "text", "source")
    assert ("limited", size) in {(r["source"], r["length"]) for r in tr.storage_limits(read).collect()}
    assert {r["doc_id"] for r in tr.judged(read).where("cut").collect()} == set(range(20))


def test_every_limit_of_a_source_and_what_decides(spark):
    """A source that stores titles as 300 characters and bodies as 400 JSON characters; both show, in their own encodings."""
    rows = []
    for i in range(40):
        rows.append((i, (f"{i:03d} " + "word " * 80)[:300], "two"))
        t = f"{i:03d} " + 'said "so" ' * i + "plain words " * 40
        while tr.lengths(t)[5] > 400:
            t = t[:-1]
        rows.append((100 + i, t if tr.lengths(t)[5] == 400 else t + "x", "two"))
        rows.append((200 + i, "The group copied files. " * (20 + i), "two"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    read = tr.readings(df, "doc_id", "text", "source")
    assert {(r["encoding"], r["length"]) for r in tr.storage_limits(read, different=True).collect()} == {("chars", 300), ("json", 400)}
    got = {r["doc_id"]: r for r in tr.judged(read).collect()}
    assert all(got[i]["step"] == "limit" and got[i]["cut"] and got[i]["at_limit"] for i in (*range(40), *range(100, 140)))
    assert all(got[i]["step"] == "ending" and not got[i]["cut"] for i in range(200, 240))
