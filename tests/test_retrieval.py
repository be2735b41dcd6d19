"""Routes and fusion against the fixtures, and the word route against SQLite's own ranking."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scores as S
from lodestone.operators import fusion, retrieval
from lodestone.plans.evaluate import Catalog, Config, retrieve

PRODUCT = "doc_id string, ord long, title string, categories array<string>, features array<string>, details array<struct<k:string,v:string>>, description array<string>, store string, price double"


@pytest.fixture(scope="module")
def shirts(spark):
    rows = [
        ("A1", 0, "Cotton everyday shirt", ["Clothing"], ["Machine washable"], [("Fit", "Regular"), ("Color", "Black")], [], "s", 20.0),
        ("A2", 1, "Cotton slim shirt", ["Clothing"], [], [("Fit", "Slim")], [], "s", 30.0),
        ("A3", 2, "Wool regular shirt", ["Clothing"], [], [("Fit", "Regular")], [], "s", 40.0),
    ]
    return Catalog.of(spark.createDataFrame(rows, PRODUCT))


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        (["cotton", "Fit: Regular"], ["A1"]),
        (["cotton", "unknown constraint"], ["A1", "A2"]),
        (["cotton", "color: black"], ["A1", "A2"]),
        (["color: chartreuse"], []),
        (["cotton", "budget around $10"], []),
        (["budget around $30"], ["A1", "A2"]),
        (["fit: regular"], ["A1", "A3"]),
        ([], []),
    ],
)
def test_exact(spark, shirts, asked, want):
    q = spark.createDataFrame([(1, c) for c in asked], "query_id long, constraint string")
    got = retrieval.in_catalog_order(retrieval.exact_matches(q, shirts.keys, shirts.materials, shirts.prices), 200)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == want


def test_exact_limit(spark, shirts):
    q = spark.createDataFrame([(1, "cotton")], "query_id long, constraint string")
    m = retrieval.exact_matches(q, shirts.keys, shirts.materials, shirts.prices)
    assert [tuple(r) for r in retrieval.in_catalog_order(m, 1).collect()] == [(1, "A1", 1.0, 1)]
    assert retrieval.in_catalog_order(m, 0).isEmpty()


def test_buckets(spark):
    shoes, dresses = ["Clothing", "Women", "Shoes", "Walking"], ["Clothing", "Women", "Dresses"]
    c = spark.createDataFrame([("A1", 0, shoes), ("A2", 1, shoes), ("A3", 2, dresses)], "doc_id string, ord long, categories array<string>")
    m = spark.createDataFrame([(1, "I'm looking for shoes  walking, but I'm still exploring."), (2, "no category"), (3, "I'm looking for hats, but I'm still exploring.")], "query_id long, message string")
    hits = retrieval.bucket_matches(m, retrieval.bucket_table(c))
    assert sorted(r["doc_id"] for r in hits.collect()) == ["A1", "A2"]
    pool = spark.createDataFrame([(q, d, i) for q in (1, 3) for i, d in enumerate(["A3", "A2", "unknown", "A1"], 1)], "query_id long, doc_id string, rank int")
    got = retrieval.bucket_filter(pool, hits).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, "A2"), (1, "A1"), (3, "A3"), (3, "A2"), (3, "unknown"), (3, "A1")]
    bands = spark.createDataFrame([(n,) for n in (0, 10, 11, 50, 51, 500, 501)], "n int").select(retrieval.bucket_band(F.col("n"))).collect()
    assert [b[0] for b in bands] == ["<=10", "<=10", "11-50", "11-50", "51-500", "51-500", ">500"]


def test_top_k_ties(spark):
    s = spark.createDataFrame([(1, d, float(x)) for d, x in (("B003", 5), ("B001", 5), ("A999", 5), ("C000", 1), ("D", 0))], "query_id long, doc_id string, score double")
    assert [r["doc_id"] for r in retrieval.ranked(s, 3).orderBy("rank").collect()] == ["A999", "B001", "B003"]
    assert retrieval.ranked(s, 5, positive=True).count() == 4


FIELDS = {"title": 10.0, "body": 1.5}


def test_bm25_equals_sqlite(spark):
    rng = random.Random(5)
    words = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu", "hen", "Béé", "ÇÄT", "señor", "straße"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE d USING fts5(id UNINDEXED, title, body, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO d VALUES (?,?,?)", rows)
    index = retrieval.WordIndex(spark.createDataFrame(rows, "doc_id long, title string, body string"), FIELDS)

    def lite(match):
        return [(int(i), -s) for i, s in db.execute("SELECT id, bm25(d, 0, 10.0, 1.5) AS s FROM d WHERE d MATCH ? ORDER BY s, CAST(id AS INTEGER) LIMIT 50", (match,))]

    def check(frame, match):
        got = {r["doc_id"]: r["score"] for r in frame.collect()}
        want = dict(lite(match))
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)

    q = spark.createDataFrame([(1, "ant bee fox")], "query_id long, query string")
    check(retrieval.bm25(q, index, 50), "ant OR bee OR fox")
    check(retrieval.bm25(q, index, 50, all_of=True), "ant AND bee AND fox")
    wide = spark.createDataFrame([(1, "ｂｅｅ senor")], "query_id long, query string")
    check(retrieval.bm25(wide, index, 50), "bee OR senor")
    pair = spark.createDataFrame([(1, "cat dog")], "query_id long, query string")
    check(retrieval.bm25_phrase(pair, index, 50), '"cat dog"')


def test_cascade(spark):
    rows = [("A", "running shoes leather", ""), ("B", "leather shoes", ""), ("C", "silk dress", ""), ("D", "shoes", "")]
    index = retrieval.WordIndex(spark.createDataFrame(rows, "doc_id string, title string, body string"), FIELDS)
    q = spark.createDataFrame([(1, "leather shoes"), (2, "")], "query_id long, query string")
    got = retrieval.bm25_cascade(q, index, 10).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["B", "A", "D"]
    assert [int(r["score"] // 1000) for r in got] == [3, 2, 1]


def test_char_grams(spark):
    got = spark.createDataFrame([("Ab c",)], "t string").select(retrieval.char_grams(F.col("t"))).first()[0]
    assert got == [" ab", "ab ", " ab ", " c "]


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "doc_id long, vector array<float>")
    q = v.filter("doc_id = 3").selectExpr("doc_id AS query_id", "vector")
    got = retrieval.dense_route(q, v, 2).orderBy("rank").collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [(3, 1.0), (2, 0.8)]
    bad = spark.createDataFrame([([float("nan"), 1.0],), ([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(S.unit_vector(F.col("v"))).collect()
    assert [r[0] for r in bad] == [[0.0, 0.0], [0.6, 0.8], [0.0, 0.0]]
    assert retrieval.vector_table_matches(v, v) and not retrieval.vector_table_matches(v, v.limit(2))
    # ties by id, through blocks of any size
    same = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.8, 0.6]) for i in range(40)], "doc_id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<float>")
    for most in (1, 30, 10_000):
        got = retrieval.dense_route(asked, same, 5, most_scores=most).orderBy("query_id", "rank").collect()
        assert [r["doc_id"] for r in got] == [1, 3, 5, 7, 9, 0, 2, 4, 6, 8]
    assert retrieval.dense_route(asked, same.limit(0), 5).isEmpty() and retrieval.dense_route(asked.limit(0), same, 5).isEmpty()


def test_vector_table(spark, tmp_path):
    catalog = spark.createDataFrame([(1, "ab"), (2, None), (3, "b")], "doc_id long, text string")

    def encode(texts):
        return [[t.count("a"), t.count("b")] for t in texts]

    path = str(tmp_path / "vectors")
    with pytest.raises(ValueError, match="no vectors"):
        retrieval.vector_table(catalog, path, encode)
    made = {r["doc_id"]: [round(x, 6) for x in r["vector"]] for r in retrieval.vector_table(catalog, path, encode, build=True).collect()}
    assert made == {1: [0.707107, 0.707107], 2: [0.0, 0.0], 3: [0.0, 1.0]}
    assert retrieval.vector_table(catalog, path).count() == 3
    with pytest.raises(ValueError, match="no vectors"):
        retrieval.vector_table(catalog.limit(2), path)


def test_catalog_candidates(spark):
    rows = [("A001", 0, "t", [], ["95% cotton 5% spandex", "machine washable"], [], [], "s", 20.0), ("A002", 1, "wool", [], ["dry clean"], [], [], "s", 40.0)]
    c = Catalog.of(spark.createDataFrame(rows, PRODUCT))
    keys = c.keys.groupBy("key").agg(F.struct(F.min("ord").alias("o"), F.first("key").alias("k")).alias("key_ord"))
    m = spark.createDataFrame([(1, "mostly cotton, 5% spandex, washable, spend no more than 20")], "query_id long, message string")
    got = [r["candidate"] for r in retrieval.catalog_candidates(m, keys).orderBy("rank").collect()]
    assert got[:3] == ["cotton", "spandex", "budget around $20"] and "95% cotton 5% spandex" in got and "machine washable" in got


def route(spark, rows, q=1):
    return spark.createDataFrame([(q, d, float(s), i) for i, (d, s) in enumerate(rows, 1)], "query_id long, doc_id string, score double, rank int")


def test_fusion(spark):
    words = route(spark, [(f"A{i:03d}", 100 - i) for i in range(10)])
    exact = route(spark, [("A003", 1), ("A019", 1)])
    dense = route(spark, [("A019", 1)])
    fused = fusion.fuse_pool(words, exact, None, dense, dense_weight=0.2).orderBy("rank").collect()
    assert fused[0]["doc_id"] == "A003" and {r["doc_id"] for r in fused} == {f"A{i:03d}" for i in range(10)}
    plain = fusion.fuse_pool(words, exact, None, dense, exact_boost=0.0).orderBy("rank").collect()
    assert [r["doc_id"] for r in plain] == [f"A{i:03d}" for i in range(10)]


def test_rrf_ties_keep_order(spark):
    a, b = route(spark, [("x", 1), ("y", 1)]), route(spark, [("y", 1), ("x", 1)])
    assert [r["doc_id"] for r in fusion.rrf([(a, 1.0), (b, 1.0), (a, 0.0)]).orderBy("rank").collect()] == ["x", "y"]


def test_confidence(spark):
    def of(scores):
        got = fusion.confidence(route(spark, [(str(i), s) for i, s in enumerate(scores)])).collect()
        return got[0]["confidence"] if got else 0.0

    assert of([]) == 0.0 and of([0.42]) == 1.0 and of([1.0] * 50) < 0.05 and of([10.0] + [0.0] * 49) > 0.9


def test_valid_recommendations(spark):
    given = spark.createDataFrame([(1, d, i) for i, d in enumerate(["A", "bad", "A", " B ", "C"])], "query_id long, doc_id string, pos int")
    known = spark.createDataFrame([("A",), ("B",), ("C",)], "doc_id string")
    assert [r["doc_id"] for r in fusion.valid_recommendations(given, known).orderBy("rank").collect()] == ["A", "B", "C"]


TITLES = [("A", "Classic Cotton T-Shirt Black M"), ("B", "Classic Cotton T-Shirt Black L"), ("C", "Wool Scarf"), ("D", "Leather Belt"), ("E", None), ("F", None)]


def test_diverse(spark):
    pool = spark.createDataFrame([(1, d, i, t) for i, (d, t) in enumerate(TITLES, 1)], "query_id long, doc_id string, rank int, title string")
    ids = lambda df: [r["doc_id"] for r in df.orderBy("rank").collect()]
    assert ids(fusion.diverse_top_k(pool, 5, 0.7)) == ["A", "C", "D", "E", "F"]
    assert ids(fusion.diverse_top_k(pool, 6, 0.7)) == ["A", "C", "D", "E", "F", "B"]
    assert ids(fusion.diverse_top_k(pool, 2, 0.7, scope="top10")) == ["A", "C"]
    pairs, keyed = fusion.near_duplicate_pairs(pool.withColumnRenamed("query_id", "pool_id"), 0.7)
    assert [(r["a"], r["b"]) for r in fusion.expand_pairs(pairs, keyed).collect()] == [("A", "B")]


def test_retrieve_turn(spark, shirts):
    turns = spark.createDataFrame([("q", "shirt cotton", ["cotton", "Fit: Regular"], None)], "query_id string, query string, active array<string>, category_message string")
    # A2 is shorter and first among the words; only A1 meets both constraints
    got = {r["doc_id"]: round(r["score"], 6) for r in retrieve(turns, shirts, Config()).collect()}
    assert got == {"A2": 1.0, "A1": 0.85, "A3": 0.0}


def test_copies_of_a_text_are_one(spark, monkeypatch):
    """Vectors are made once a text, however many documents have it; the first documents of texts that tie are the answer."""
    sizes = {}
    store = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: (out := store(df, name), sizes.__setitem__(name, out.count()))[0])
    q = spark.createDataFrame([(1, "red gear"), (2, "zzz")], "query_id long, query string")

    def run(copies):
        texts = ["red gear", "gear red", "red bolt", "blue ring", None, ""]
        docs = spark.createDataFrame([(i * len(texts) + j, t) for i in range(copies) for j, t in enumerate(texts)], "doc_id long, text string")
        rows = retrieval.ngram_route(q, docs, 7, min_df=1, digits=6).orderBy("query_id", "rank").collect()
        return [(r["query_id"], r["doc_id"]) for r in rows], dict(sizes)

    few, at_few = run(5)
    many, at_many = run(40)
    assert few == many == [(1, d) for d in (0, 1, 6, 7, 12, 13, 18)]
    assert at_few == at_many and at_few["texts"] == 5


def test_products_are_spread(spark):
    """A small file is one task, whatever its rows become."""
    from lodestone import queries

    assert queries.products(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_candidates_are_made_where_messages_are(spark):
    """Only messages are shuffled, not the rows of messages and keys."""
    m = spark.createDataFrame([(1, "brand: acme, wool, budget $20"), (2, None)], "query_id long, message string")
    keys = spark.createDataFrame([("Brand: Acme", 0), ("brand: acme", 0), ("Size: 4", 1)], "key string, key_ord long")
    got = retrieval.catalog_candidates(m, keys)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r["query_id"], r["candidate"].lower(), r["shared"]) for r in got.orderBy("rank").collect()] == [(1, "wool", 100), (1, "budget around $20", 90), (1, "brand: acme", 2)]


def test_pools_are_read_one_after_another(spark):
    """Batches may cut a pool anywhere, and no pool is a frame of its own."""
    rows = [(q, f"{q}-{i}", i, ["red shoe", "red shoe", "blue hat", "red shoe", ""][i % 5]) for q in range(30) for i in range(1, 8)]
    pool = spark.createDataFrame(rows, "query_id long, doc_id string, rank int, title string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = fusion.diverse_top_k(pool, 4, 0.7)
        got = {(r["query_id"], r["rank"]): r["doc_id"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(q, n): f"{q}-{i}" for q in range(30) for n, i in enumerate((1, 2, 4, 3), 1)}
    assert "InPandas" not in out._jdf.queryExecution().executedPlan().toString()
