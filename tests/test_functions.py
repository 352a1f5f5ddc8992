import pytest
from pyspark.sql import functions as F

from skarn.functions import indicators as ioc
from skarn.functions import sets as st
from skarn.functions import text as tx


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,plain", [("1[.]2(.)3{dot}4", "1.2.3.4"), ("a(at)b", "a@b"), ("hxxp[:]//x[.]y", "hxxp://x.y"), ("plain.", "plain."), (None, None), ("", "")])
def test_refang(spark, raw, plain):
    assert one(spark, raw, ioc.refang) == plain


def test_mask(spark):
    assert one(spark, f"see http://ab.test/x, 10.0.0.1 and {'a' * 32}", ioc.mask) == "see [URL], [IP] and [HASH]"


def test_indicators(spark):
    got = {(r["kind"], r["value"]) for r in one(spark, f"CVE-2024-12345 at 203.0.113[.]9, {'Ab' * 32} HKLM\\Soft\\x c:\\a\\b.exe", ioc.indicators)}
    assert {("CVE", "CVE-2024-12345"), ("IPv4", "203.0.113[.]9"), ("SHA256", "Ab" * 32), ("REGISTRY", "HKLM\\Soft\\x"), ("FILE", "b.exe")} <= got
    assert one(spark, None, ioc.indicators) == []


def test_chunks(spark):
    got = one(spark, "x" * 1000, lambda t: tx.char_chunks(t))
    assert [r["start"] for r in got] == [0, 480, 960] and [len(r["chunk"]) for r in got] == [500, 500, 40]
    assert one(spark, "x" * 20, lambda t: tx.char_chunks(t)) == []


def test_clear_text(spark):
    assert one(spark, "Windows  NT\\n\tä \\x41\\x42 ok", tx.clear_text) == "windowsnt    ok"


@pytest.mark.parametrize("a,b", [("end", "end."), ("end. ", "end.."), ("end;", "end;"), ("", "."), (None, None)])
def test_add_punctuation(spark, a, b):
    assert one(spark, a, tx.add_punctuation) == b


def test_markdown_and_marks(spark):
    assert one(spark, "# T\n* **b** [l](u) `c` (Citation: x) rest", tx.markdown_text) == "T\nb l c"
    assert one(spark, "a[1] b[23]", tx.drop_references) == "a b"
    assert one(spark, '"q"', tx.unquote) == "q"


@pytest.mark.parametrize(
    "true,pred,want", [([], [], (1, 1, 1, 1)), ([], ["a"], (0, 0, 0, 0)), (["a"], [], (0, 0, 0, 0)), (["a", "b"], ["b", "c"], (0.5, 0.5, 1 / 3, 0.5)), (["a", "a"], ["a"], (1, 1, 1, 1))]
)
def test_set_scores(spark, true, pred, want):
    df = spark.createDataFrame([(true, pred)], "t array<string>, p array<string>")
    s = st.set_scores(F.col("t"), F.col("p"))
    r = df.select(*[s[k].alias(k) for k in ("precision", "recall", "accuracy", "f1")]).first()
    assert tuple(r) == pytest.approx(want)


def test_labels_and_collapse(spark):
    assert one(spark, [" t1059.003\n", None, "", "TA0011", "T1059"], lambda c: st.collapse(st.labels(c)), "array<string>") == ["T1059", "TA0011", "T1059"]
    assert one(spark, None, st.labels, "array<string>") == []


def test_hosts_urls_and_addresses_in_all_forms():
    import re

    from skarn.functions import indicators as ioc

    def hits(kind, text):
        return [m.group() for m in re.finditer(ioc.PATTERN[kind], text, re.ASCII)]

    text = "see a-cdn[.]example[.]org/a/b?c=d, hxxps[:]//evil[.]com/p. www.site.sh x(dot)y(dot)de. run.sh lib.so a.zip ftp://1.2.3.4/x mail dot com anecdotes"
    assert hits("URL", text) == ["a-cdn[.]example[.]org/a/b?c=d", "hxxps[:]//evil[.]com/p", "www.site.sh", "x(dot)y(dot)de", "ftp://1.2.3.4/x"]
    six = ["1:2:3:4:5:6:7:8", "::8", "1::", "1::8", "1:2:3::7:8", "fe80::7:8%eth0", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "2001:db8:3:4::192.0.2.33", "2001[:]db8::1", "::255.255.255.255", "1:2:3:4:5:6:192.0.2.1"]
    assert [hits("IPv6", f"x {s} y") for s in six] == [[s] for s in six]
    assert hits("IPv6", "at 12:30:45 std::vector") == []
    assert ioc.top_level_domains("# list\nCOM\nxn--abc\n\nmuseum\nde") == ["museum", "com", "de"]


def test_protection_tells_kinds_apart(spark):
    from skarn.functions import indicators as ioc
    from skarn.operators.strings import protect

    df = spark.createDataFrame([(1, "drop.exe /q --out=x opened a.pdf from evil[.]com"), (2, None)], "i int, t string")
    pats = [*ioc.PROTECTED, *((k, p) for k, p in ioc.CATALOG if k in ioc.STAND_INS and k != "URL")]
    row = protect(df, "i", "t", pats, ioc.STAND_INS).collect()[0]
    assert " ".join(row["protected"].split()) == "executable opened document from host"
    assert sorted(row["originals"].values()) == [" /q --out=x", "a.pdf", "drop.exe", "evil[.]com"]
