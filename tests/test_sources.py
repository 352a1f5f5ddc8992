import json

from skarn.sources import readers as rd
from skarn.streaming import windows as sw


def test_text_and_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two")
    (tmp_path / "labels.json").write_text(json.dumps({"a": ["T1", "T2"], "b": []}))
    assert [r["text"] for r in rd.reports(spark, str(tmp_path / "*.txt")).collect()] == ["line one\nline two"]
    assert {r["file"]: r["labels"] for r in rd.label_map(spark, str(tmp_path / "labels.json")).collect()} == {"a": ["T1", "T2"], "b": []}


def test_parsed_docs_prefer_matches(spark, tmp_path):
    doc = {"text": "x", "ents": [{"start": 0, "end": 1, "label": "A"}], "sents": [], "tokens": []}
    (tmp_path / "1.json").write_text(json.dumps(doc | {"_": {"ner_matches": [{"start": 0, "end": 2, "label": "B"}]}}))
    (tmp_path / "2.json").write_text(json.dumps(doc))
    assert sorted(r["spans"][0]["label"] for r in rd.parsed_docs(spark, str(tmp_path)).collect()) == ["A", "B"]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 'say "x"\nnext', "v", "2020", "u", "10.1/x", "t", 3)], rd.PAPER)
    rd.write_csv(df, str(tmp_path / "p"))
    assert [tuple(r) for r in rd.papers(spark, str(tmp_path / "p")).collect()] == [tuple(r) for r in df.collect()]


def test_embeddings_vocab_tags_spans(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes('ID,name,description,embedding\nT1,n\xe9,d,"[0.5, -1.0]"\n'.encode("latin-1"))
    r = rd.embedding_table(spark, str(tmp_path / "e.csv")).first()
    assert r["name"] == "né" and r["embedding"] == [0.5, -1.0]
    v = spark.createDataFrame([("a b", 3), ("c", 1)], "token string, n bigint")
    rd.write_vocab(v, str(tmp_path / "v"))
    assert {tuple(r) for r in rd.read_vocab(spark, str(tmp_path / "v")).collect()} == {("a b", 3), ("c", 1)}
    (tmp_path / "t.txt").write_text("He O\nran B\n\nYes O\n")
    got = [(r["sent"], r["i"], r["word"], r["tag"]) for r in rd.tagged_words(spark, str(tmp_path / "t.txt")).orderBy("sent", "i").collect()]
    assert got == [(0, 0, "He", "O"), (0, 1, "ran", "B"), (1, 0, "Yes", "O")]
    (tmp_path / "s.json").write_text(json.dumps({"data": "abc", "label": [[0, 1, "X"]]}) + "\n")
    assert [tuple(r) for r in rd.annotated_spans(spark, str(tmp_path / "s.json")).collect()] == [("abc", 0, 1, "X")]


def test_stix_and_templates(spark, tmp_path):
    obj = {"type": "attack-pattern", "name": "N", "description": "D", "aliases": ["a"], "external_references": [{"source_name": "other", "external_id": "x"}, {"source_name": "mitre-attack", "external_id": "T1"}]}
    (tmp_path / "stix.json").write_text(json.dumps({"objects": [obj, obj | {"revoked": True}, obj | {"external_references": []}]}))
    assert [(r["id"], r["name"], r["aliases"]) for r in rd.stix_concepts(spark, str(tmp_path / "stix.json")).collect()] == [("T1", "N", ["a"])]
    d = tmp_path / "templates"
    d.mkdir()
    (d / "T1.json").write_text(json.dumps({"nodes": [{"type": "file", "nlp": ["x"], "ioc": [], "count": 4}], "edges": [[[0, 0], 2]], "instances": [[[0]]], "total_count": 1}))
    r = rd.templates(spark, str(d)).first()
    assert r["technique"] == "T1" and r["nodes"][0]["count"] == 4 and json.loads(r["edges"][0][0]) == [0, 0]


def test_binary_and_columns(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.4")
    assert rd.binary_reports(spark, str(tmp_path / "x.bin")).first()["kind"] == "pdf"
    (tmp_path / "c.json").write_text(json.dumps({"sentence": {"0": "a", "1": "b"}}))
    assert {r["row"]: r["sentence"] for r in rd.column_json(spark, str(tmp_path / "c.json"), "sentence").collect()} == {"0": "a", "1": "b"}


def test_same_windows_on_a_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = sw.stream_table(spark, str(tmp_path / "in"), batch.schema)
    q = sw.tumbling(stream, "ts", "1 hour", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("hourly").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(str, sw.tumbling(batch, "ts", "1 hour", "event_type", "value").select("start", "event_type", "n").collect()))
    assert sorted(map(str, spark.sql("SELECT start, event_type, n FROM hourly").collect())) == want
