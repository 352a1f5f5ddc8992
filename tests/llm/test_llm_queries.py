import duckdb
import pytest

from skarn.llm.queries import oracle_sql, queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("tram_train", "bosch_train", "syn_sentence_list", "label_targets", "rag_db"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = queries()[name](spark, D)
    rel = c.execute(oracle_sql()[name])
    cols = [x[0] for x in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in rel.fetchall()))) == sorted(str(tuple(r)) for r in df.select(*cols).collect())


# What every query without SQL must give on the small tables: the least rows, and columns that hold no null.
LEAST = {
    "p2_found": (1, ["id_a", "id_b"]), "p2_neighbours": (1000, ["id", "rank", "neighbour", "cosine"]), "p3_sample": (40, ["syn_id", "category", "augmented_sentence", "weight"]),
    "p3_shares": (44, ["category", "drawn"]), "p4_found": (1, ["id_a", "id_b"]), "p4_classes": (20, ["sent_id", "class_id", "links"]), "p4_report": (1, ["split", "links", "pairs"]),
    "p5_pieces": (20, ["rag_id", "piece"]), "p6_found": (10, ["keep_id", "paper_id"]), "p6_records": (50, ["keep_id", "copies"]), "p7_ids": (100, ["doc_id"]),
    "p8_containers": (5, ["container_id", "doc_ids", "fill"]), "p9_limits": (0, ["encoding", "length"]), "p9_report": (10, ["texts", "cut_texts", "share"]), "p9_found": (1, ["doc_id"]),
}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows(spark, name):
    df = queries()[name](spark, D)
    least, full = LEAST[name]
    rows = df.collect()
    assert len(rows) >= least and len(set(df.columns)) == len(df.columns)
    assert all(r[c] is not None for r in rows for c in full)


def test_overlaps_against_brute_force(spark):
    """Whole small tables: all pairs of the splits by a plain edit distance."""
    import regex

    def words(t):
        return [(r["sent_id"], w) for r in spark.read.parquet(f"{D}/{t}.parquet").select("sent_id", "sentence").collect() if (w := regex.findall(r"[\p{L}\p{N}]+", (r["sentence"] or "").lower()))]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = set()
    for j, b in words("tram_train") + words("tram_train_augmented_artificial"):
        for i, a in words("tram_test"):
            n = max(len(a), len(b))
            shared = len(set(a) & set(b))
            if abs(len(a) - len(b)) <= n // 10 and len(set(a)) - shared <= n // 10 and edits(a, b) <= n // 10:
                want.add((min(i, j), max(i, j)))
    assert {tuple(r) for r in queries()["p4_found"](spark, D).collect()} == want and want


def test_equal_papers_against_brute_force(spark):
    from skarn.llm import multiset as ms

    groups = {}
    for r in spark.read.parquet(f"{D}/paper_rows.parquet").collect():
        if key := ms.letters(r["title"]):
            groups.setdefault((key, tuple(sorted(ms.author_words(r["authors"]))), ms.doi_letters(r["doi"])), []).append(r["paper_id"])
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in queries()["p6_found"](spark, D).collect()} == want and want


def test_columns_of_the_found_queries(spark):
    want = {
        "p1_found": [("dataset", "string"), ("label", "string"), ("mark", "string")], "p2_found": [("id_a", "bigint"), ("id_b", "bigint")], "p3_found": [("category", "string")],
        "p4_found": [("id_a", "bigint"), ("id_b", "bigint")], "p5_found": [("rag_id", "bigint"), ("cut", "string")], "p6_found": [("keep_id", "bigint"), ("paper_id", "bigint")], "p9_found": [("doc_id", "bigint")],
    }
    for k, v in want.items():
        assert queries()[k](spark, D).dtypes == v
