"""Analyses, traces and single requests."""

from pyspark.sql import functions as F

from lodestone.operators import analysis, retrieval
from lodestone.plans import dialog, simulate
from lodestone.plans.agent import Agent
from lodestone.plans.evaluate import ABLATIONS, Catalog, evaluate

from .test_retrieval import PRODUCT, TITLES
from .test_sessions import OVERRIDE, shop, talk


def test_opening_analysis(spark):
    m = spark.createDataFrame([(1, "I'm looking for shoes, but I'm still exploring.", "A"), (2, "hello", "A"), (3, "I'm looking for hats, but I'm still exploring.", "A")], "query_id long, message string, target string")
    b = spark.createDataFrame([("shoes", "A", 0)], "phrase string, doc_id string, ord long")
    assert tuple(analysis.opening_analysis(m, b).first()) == (3, 2, 1, 1, 1)


def test_prevalence_and_sweep(spark):
    pool = spark.createDataFrame([(1, d, i, t) for i, (d, t) in enumerate(TITLES, 1)], "query_id long, doc_id string, rank int, title string")
    assert tuple(analysis.duplicate_prevalence(pool.withColumnRenamed("query_id", "pool_id"), 0.7).first()) == (1, 1, 1, 1.0)
    target = spark.createDataFrame([(1, "C")], "query_id long, target string")
    rows = {(r["scope"], r["threshold"]): r["mrr"] for r in analysis.similarity_sweep(pool, target, 3, (0.7, 0.95)).collect()}
    assert rows == {("top10", 0.7): 0.5, ("full", 0.7): 0.5, ("top10", 0.95): 1 / 3, ("full", 0.95): 1 / 3}


def test_states(spark):
    states = dialog.fold_sessions(talk(spark, [*OVERRIDE, "I don't have an additional preference for other."]))
    assert [tuple(r) for r in analysis.drain_turns(states).collect()] == [("intent_override", 5, 1)]
    truth = spark.createDataFrame([("s", "intent_override")], "session_id string, scenario_type string")
    assert tuple(analysis.router_accuracy(states, truth).first()) == ("intent_override", 1, 1.0)
    last = {r["attribute"]: r["values"] for r in analysis.slots_by_attribute(states.filter("turn = 5")).collect()}
    assert last == {"material": ["cotton", "wool"], "color": ["color: black"]}


def test_traces(spark):
    p = shop(spark)
    card = F.struct(F.lit("x").alias("target_category"), F.array(F.lit("cotton"), F.lit("Fit: Wide")).alias("hard_constraints"), F.array(F.lit("cotton lining")).alias("soft_preferences"))
    samples = spark.createDataFrame([("s1", "buying", "missing")], "sample_id string, scenario_type string, target string").select("*", F.lit("Shoes Casual").alias("category"), card.alias("card"))
    samples = samples.withColumn("override", F.when(F.lit(False), simulate.override(F.col("card"), F.lit(3))))
    traces = []
    config = ABLATIONS["shipped"].__class__(turns=2)
    out = evaluate(samples, Catalog.of(p), config, rephrase=F.upper, traces=traces).collect()
    assert not out[0]["hit"] and len(traces) == 2
    row = traces[0].first()
    assert row["perturbed_message"] == row["original_message"].upper() and 0 <= row["confidence"] <= 1


def test_agent(spark):
    rows = [(f"A{i:02d}", i, f"shoe number {i}", ["Clothing", "Shoes", "Casual"], ["leather upper"] if i == 7 else [], [], [], "s", 10.0 + i) for i in range(30)]
    agent = Agent(Catalog.of(spark.createDataFrame(rows, PRODUCT)))
    agent.reset("s", {"rating_style": "x"})
    one = agent.respond("s", "I'm looking for Shoes Casual. A key requirement is: leather.", 1)
    items = [r["parent_asin"] for r in one["recommendations"]]
    assert items[0] == "A07" and len(set(items)) == 10 and one["ask_attribute"] == "other"
    two = [r["parent_asin"] for r in agent.respond("s", "I don't have an additional preference for other.", 2)["recommendations"]]
    assert not set(two) & set(items)
    again = [r["parent_asin"] for r in agent.respond("s", "Actually, ignore my earlier preference. What I need is: leather upper.", 3)["recommendations"]]
    assert again[0] == "A07"


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ant bee"), (2, "bee cat")], "doc_id long, text string")
    index = retrieval.WordIndex(docs, {"text": 1.0}, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "ant cat")], "query_id long, query string")
    stored = retrieval.WordIndex.stored(spark, str(tmp_path / "index"), {"text": 1.0})
    assert sorted(map(tuple, retrieval.bm25(q, index).collect())) == sorted(map(tuple, retrieval.bm25(q, stored).collect()))
    frame = retrieval.collect_routes({"words": type("R", (), {"query": lambda self, q, k: retrieval.bm25(q, stored, k)})()}, q, 5)
    assert frame.columns == ["route", "query_id", "doc_id", "score", "rank"]
