"""Metrics, splits, state, simulation, evaluation, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fill, metrics, resample
from lodestone.operators.ordering import numbered, value_at
from lodestone.plans import dialog, llm_hooks, settings, simulate
from lodestone.plans.evaluate import Catalog, Config, evaluate, limit_sweep, suppressed_targets
from lodestone.plans.replay import Replay, transcripts
from lodestone.sources import catalog as sources
from lodestone.streaming import sessions as streams

from .test_retrieval import PRODUCT

SESSION = "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double"


def test_metrics(spark):
    s = spark.createDataFrame([("a", "buying", True, 2, 2, 0.5), ("b", "buying", False, None, None, 0.0)], SESSION)
    rows = {r["scenario_type"]: r for r in metrics.session_metrics(s).collect()}
    assert (rows[None]["hit_rate_at_10"], rows[None]["mrr"], rows[None]["mttc"]) == (0.5, 0.25, 6.5)
    assert rows["buying"]["technical_score"] == pytest.approx(0.5 * 0.5 + 0.3 * 0.25 + 0.2 * 0.45)


def test_telemetry(spark):
    rows = [("m", "m", 0.1, 40, 10, 0.0), ("m", None, 0.3, 60, 20, 0.0)]
    r = metrics.telemetry(spark.createDataFrame(rows, "requested_model string, served_model string, latency_seconds double, prompt_tokens long, completion_tokens long, cost double"), 2, 2.0, 4.0).first()
    assert (r["p50_ms"], r["p95_ms"], r["total_tokens"]) == (pytest.approx(200), pytest.approx(290), 130)
    assert r["cost_per_session"] == pytest.approx(0.00016)


def test_movement(spark):
    before = spark.createDataFrame([("a", "x", True, 1, 3, 1 / 3), ("b", "x", True, 1, 1, 1.0), ("c", "x", True, 2, 2, 0.5)], SESSION)
    after = spark.createDataFrame([("a", "x", True, 1, 1, 1.0), ("b", "x", False, None, None, 0.0), ("c", "x", True, 1, 2, 0.5)], SESSION)
    m = metrics.movement_counts(before, after).first()
    assert (m["target_suppressed"], m["moved_up"], m["moved_down"], m["unchanged"], m["average_rank_improvement"]) == (1, 1, 0, 1, 2.0)
    d = {r["sample_id"]: (r["outcome"], r["rank_movement"]) for r in metrics.robustness_deltas(before, after).collect()}
    assert d == {"a": ("improved", "improved"), "b": ("worsened", "disappeared"), "c": ("improved", "unchanged")}


def test_folds(spark):
    kinds = resample.SCENARIOS
    rows = [(f"s{i:02d}", kinds[i % 4]) for i in range(20)]
    edges = spark.createDataFrame([("s00", "s04"), ("s04", "s08")], "a string, b string")
    one = resample.fold_manifest(spark.createDataFrame(rows, "sample_id string, scenario_type string"), edges)
    two = resample.fold_manifest(spark.createDataFrame(rows[::-1], "sample_id string, scenario_type string"), edges)
    assert one == two
    where = {i: f["name"] for f in one["folds"] for i in f["validation_sample_ids"]}
    assert len(where) == 20 and where["s00"] == where["s04"] == where["s08"]
    samples = spark.createDataFrame(rows, "sample_id string, scenario_type string")
    resample.validate_manifest(samples, one)
    bad = json.loads(json.dumps(one))
    bad["folds"][0]["validation_sample_ids"].append(bad["folds"][1]["validation_sample_ids"][0])
    with pytest.raises(ValueError, match="two folds"):
        resample.validate_manifest(samples, bad)
    counts = [f["scenario_counts"] for f in one["folds"]]
    assert all(sum(c[k] for c in counts) == 5 and max(c[k] for c in counts) <= 3 for k in kinds)
    assert resample.select_folds(spark, one).count() == 20
    some = resample.select_folds(spark, one, " fold_1, fold_3 ").collect()
    assert {r["fold"] for r in some} == {"fold_1", "fold_3"}
    with pytest.raises(ValueError, match="unknown folds: fold_9"):
        resample.select_folds(spark, one, "fold_1,fold_9")
    with pytest.raises(ValueError, match="no folds"):
        resample.select_folds(spark, one, ",")


def test_fold_report(spark):
    rows = spark.createDataFrame([("c", 0, 1.0), ("c", 0, 0.0), ("c", 1, 1.0)], "config string, fold int, reciprocal_rank double")
    r = metrics.fold_report(rows, "config", "fold", F.avg("reciprocal_rank")).first()
    assert (r["mean"], r["worst"], r["best"], r["folds"], round(r["out_of_fold"], 6), r["pstdev"]) == (0.75, 0.5, 1.0, 2, 0.666667, 0.25)


def test_file_digest(tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"x" * 3000)
    assert resample.file_digest(str(tmp_path / "f"), 1000) == hashlib.sha256(b"x" * 3000).hexdigest()


def test_select_samples(spark):
    s = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert resample.select_samples(s, s.limit(1)).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        resample.select_samples(s, spark.createDataFrame([("z",)], "sample_id string"))
    with pytest.raises(ValueError, match="more than once"):
        resample.select_samples(s, spark.createDataFrame([("a",), ("a",)], "sample_id string"))


def talk(spark, texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts, 1)], "session_id string, turn int, message string")


OVERRIDE = [
    "I'm looking for shirts. Department: Womens",
    "For that, what matters is: cotton; color: black.",
    "Actually, ignore my earlier preference. What I need is: wool.",
    "For that, what matters is: Department: Womens.",
]


def test_state_override(spark):
    rows = dialog.fold_sessions(talk(spark, OVERRIDE)).orderBy("turn").collect()
    assert [r["active"] for r in rows] == [["Department: Womens"], ["Department: Womens", "cotton", "color: black"], ["cotton", "color: black", "wool"], ["cotton", "color: black", "wool"]]
    last = rows[3]["state"]
    assert last["soft"] == ["Department: Womens"] and last["override_count"] == 1 and last["epoch"] == 1 and last["category"] == "shirts"


def test_state_scenarios(spark):
    texts = ["I'm looking for X, but I'm still exploring.", "I don't have a preference for other; please use your judgment.", "I don't have an additional preference for other."]
    states = [r["state"] for r in dialog.fold_sessions(talk(spark, texts)).orderBy("turn").collect()]
    assert [s["scenario"] for s in states] == ["browsing_or_boundary", "boundary", "boundary"]
    assert states[1]["boundary_seen"] and states[2]["other_exhausted"]
    with pytest.raises(ValueError, match="unsupported"):
        dialog.record_ask(dialog.new_state(), "weather")


def test_fill(spark):
    catalog = numbered(spark.createDataFrame([(f"A{i:02d}", 10 * i) for i in range(30)], "doc_id string, ord long"), ["ord"])
    assert sorted((r["position"], r["doc_id"]) for r in catalog.collect()) == [(i, f"A{i:02d}") for i in range(30)]
    requests = spark.createDataFrame([(q, f"k{q}", 2) for q in range(4)], "query_id long, key string, turn int")
    found = spark.createDataFrame([(0, "A03", 1), (0, "gone", 2), (0, "A03", 3), (0, "A05", 4), *[(1, f"A{i:02d}", i) for i in range(12)]], "query_id long, doc_id string, rank int")
    shown = spark.createDataFrame([(0, "A05"), *[(2, f"A{i:02d}") for i in range(25)], *[(3, f"A{i:02d}") for i in range(30)]], "query_id long, doc_id string")

    def of(requests):
        out = {}
        for r in fill.recommendations(requests, found, catalog, shown).orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["doc_id"])
        return out

    got = of(requests)
    assert got == of(requests) and all(len(set(v)) == 10 for v in got.values())
    assert got[0][0] == "A03" and "A05" not in got[0] and "gone" not in got[0] and got[1] == [f"A{i:02d}" for i in range(10)]
    # what was not shown comes first, in the catalog's order from some place on
    assert set(got[2][:5]) == {f"A{i}" for i in range(25, 30)} and all(d in {f"A{i:02d}" for i in range(30)} for d in got[3])
    few = fill.recommendations(requests.limit(1), found.limit(0), catalog.filter("position = 0"), shown.limit(0), 3)
    assert [r["doc_id"] for r in few.orderBy("rank").collect()] == ["A00", "__missing_catalog_0", "__missing_catalog_1"]
    none = fill.recommendations(requests.limit(1), found.limit(0), catalog.limit(0), shown.limit(0), 2)
    assert [r["doc_id"] for r in none.orderBy("rank").collect()] == ["__missing_catalog_0", "__missing_catalog_1"]


def test_numbered(spark):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("kind")).repartition(5)
    got = numbered(rows, ["x"], ["kind"]).collect()
    for kind in (None, 1, 2):
        own = sorted((r["position"], r["x"]) for r in got if r["kind"] == kind)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    assert [r["x"] for r in numbered(rows, [-F.col("x")]).filter("position < 3").orderBy("position").collect()] == sorted((i * 7919 % 20_011 for i in range(20_000)), reverse=True)[:3]
    assert value_at(rows, "x", 10).first()["x"] == sorted(i * 7919 % 20_011 for i in range(20_000))[10] and value_at(rows.limit(0), "x", 0).isEmpty()


def test_safe_attributes():
    assert dialog.safe_attribute("color") == "color" and dialog.safe_attribute("brand") == dialog.safe_attribute(None) == dialog.safe_attribute("category") == "other"
    state, asked = dialog.new_state(), []
    for _ in range(7):
        asked.append(dialog.next_ask(state, "other_twice_rotate"))
        dialog.record_ask(state, asked[-1])
    assert asked == ["other", "other", "feature", "material", "color", "style", "feature"] and dialog.next_ask(state, "always_other") == "other"


def test_fold_in_many_batches(spark):
    """Sessions that are cut by batches give the states of sessions that are folded alone."""
    rows = spark.createDataFrame([(s, t, m) for s in range(40) for t, m in enumerate(OVERRIDE, 1)], "session_id long, turn int, message string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r["session_id"], r["turn"]): (r["active"], r["state"]["soft"], r["state"]["epoch"]) for r in dialog.fold_sessions(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one = {r["turn"]: (r["active"], r["state"]["soft"], r["state"]["epoch"]) for r in dialog.fold_sessions(rows.filter("session_id = 3")).collect()}
    assert len(got) == 160 and all(got[s, t] == one[t] for s in range(40) for t in one)


def test_epochs(spark):
    rows = spark.createDataFrame([("s", i, m) for i, m in enumerate(OVERRIDE)], "session_id string, turn int, message string")
    got = dialog.epochs(rows, ["session_id"], ["turn"], T.is_override(F.col("message"))).orderBy("turn").collect()
    assert [r["epoch"] for r in got] == [0, 0, 1, 1]


def shop(spark):
    rows = [
        ("A", 0, "Canvas shoe", ["Clothing", "Shoes", "Casual"], ["cotton lining"], [("Fit", "Wide")], [], "s", 49.0),
        ("B", 1, "Leather boot", ["Clothing", "Shoes", "Boots"], ["leather upper"], [], [], "s", 89.0),
    ]
    return spark.createDataFrame(rows, PRODUCT)


def test_intent_card_and_replies(spark):
    p = shop(spark)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    card = p.select("doc_id", simulate.intent_card(F.col("title"), F.col("features"), F.col("details"), text, F.col("price")).alias("c")).orderBy("doc_id").first()["c"]
    assert card["hard_constraints"] == ["cotton", "cotton lining"] and card["soft_preferences"] == ["Fit: Wide", "budget around $49.0"]


def test_evaluation(spark):
    p = shop(spark)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    cards = p.select(F.col("doc_id").alias("target"), T.coarse_category(F.col("categories")).alias("category"), simulate.intent_card(F.col("title"), F.col("features"), F.col("details"), text, F.col("price")).alias("card"))
    who = spark.createDataFrame([("s1", "buying", "A"), ("s2", "intent_override", "B"), ("s3", "boundary", "B")], "sample_id string, scenario_type string, target string")
    samples = who.join(cards, "target").withColumn("override", F.when(F.col("scenario_type") == "intent_override", simulate.override(F.col("card"), simulate.override_turn(F.col("sample_id"), F.col("scenario_type")))))
    got = {r["sample_id"]: r for r in evaluate(samples, Catalog.of(p)).collect()}
    assert all(r["hit"] for r in got.values())
    assert got["s1"]["first_hit_turn"] == 1 and got["s2"]["first_hit_turn"] in (3, 4) and got["s3"]["first_hit_turn"] == 1


def test_catalog_policies(spark, tmp_path):
    good = [{"parent_asin": "A", "title": "one", "details": {"z": 1, "a": None}}, {"parent_asin": "B", "title": "two"}, {"parent_asin": "A", "title": "three"}]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(map(json.dumps, good)) + "\n\n")
    read = lambda policy: {r["parent_asin"]: r["title"] for r in sources.read_catalog(spark, str(path), policy).collect()}
    assert read("tolerant") == read("first") == {"A": "one", "B": "two"}
    assert read("last") == {"A": "three", "B": "two"}
    with pytest.raises(ValueError, match="Duplicate parent_asin A"):
        read("strict")
    row = sources.read_catalog(spark, str(path)).filter("parent_asin = 'A'").first()
    assert sorted(e["k"] for e in row["details"]) == ["a", "z"]
    path.write_text('{"parent_asin": "A", "title": "one"}\nnot json\n{"title": "no id"}\n')
    assert read("tolerant") == {"A": "one"}
    with pytest.raises(ValueError, match="no JSON object in .*c.jsonl at line 2"):
        read("first")
    path.write_text('{"parent_asin": "A", "title": "one"}\n\n\n[1]\n')
    with pytest.raises(ValueError, match="at line 4"):
        read("last")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.5), ("y", None)], "name string, score double")
    sources.write_csv(df, str(tmp_path / "csv"), ["score", "name"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["score", "name"] and back.count() == 2
    assert sources.relabelled(df, "name", ["x"], "old_").first()["name"] == "old_x"
    assert sources.relabelled(df.withColumn("name", F.lit("old_x")), "name", ["x"], "old_").first()["name"] == "old_x"
    sources.write_csv(df, str(tmp_path / "csv"), ["score", "name"], append=True)
    assert sources.read_csv(spark, str(tmp_path / "csv")).filter("name = 'x'").count() == 2
    runs = spark.createDataFrame([("llm_on_4", "yes"), ("historical_llm_on_3", "historical; not rerun"), ("llm_on_2", "no"), ("plain", "yes")], "mode string, available string")
    sources.write_csv(runs, str(tmp_path / "runs"), ["mode", "available"])
    kept = sources.kept_runs(spark, str(tmp_path / "runs")).collect()
    assert sorted(map(tuple, kept)) == [("historical_llm_on_3", "historical; not rerun"), ("historical_llm_on_4", "historical; not rerun")]
    assert sources.kept_runs(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="more than 1 rows"):
        sources.markdown_table(df, 1, 1)
    levels = spark.createDataFrame([(0, 0.9), (4, 0.4)], "level int, score double")
    scenarios = spark.createDataFrame([(0, "buying", 0.9)], "level int, scenario_type string, mrr double")
    report = sources.robustness_report(levels, scenarios, levels.limit(0), spark.createDataFrame([(4, "lost"), (4, "lost")], "level int, reason string"))
    assert "score 0.900000" in report and "| 4 | lost | 2 |" in report and report.count("## ") == 4
    assert sources.markdown_table(df.orderBy("name"), 1) == "| name | score |\n| --- | --- |\n| x | 1.5 |\n| y |  |\n"


def test_stream_equals_batch(spark, tmp_path):
    rows = talk(spark, OVERRIDE)
    rows.filter("turn <= 2").write.json(str(tmp_path / "in"))
    stream = streams.conversation_states(spark.readStream.schema(rows.schema).json(str(tmp_path / "in")))

    def go():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    rows.filter("turn > 2").write.mode("append").json(str(tmp_path / "in"))
    go()
    got = {r["turn"]: r["active"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["turn"]: r["active"] for r in dialog.fold_sessions(rows).collect()}
    assert got == want


def test_guarded_client(spark):
    good = {"model": "m:free", "usage": {"cost": 0, "prompt_tokens": "7", "completion_tokens": 2}, "choices": [{"message": {"content": " yes "}}]}
    asked = []

    def transport(request, seconds):
        asked.append((request["temperature"], seconds))
        return good

    client = llm_hooks.GuardedClient(transport, "m:free")
    assert client("s", "u", 5) == client("s", "u", 5) == "yes" and asked == [(0, 3.0)]
    assert client("s", " ", 5) is None and client("s", "u", 0) is None and llm_hooks.GuardedClient(transport, "m")("s", "u", 5) is None and llm_hooks.GuardedClient(None, "m:free")("s", "u", 5) is None
    bad = [({**good, "model": "other"}, "model_mismatch"), ({**good, "usage": {"cost": 0.1}}, "nonzero_cost"), ({**good, "usage": {}}, "invalid_cost"), ({**good, "choices": []}, "missing_choices"), ([], "invalid_json_shape")]
    for reply, outcome in bad:
        other = llm_hooks.GuardedClient(lambda request, seconds, reply=reply: reply, "m:free")
        assert other("s", "u", 5) is None and other.records[0]["outcome"] == outcome

    def late(request, seconds):
        raise TimeoutError

    other = llm_hooks.GuardedClient(late, "m:free")
    assert other("s", "u", 5) is None and other.records[0]["outcome"] == "TimeoutError"
    row = client.telemetry(spark).first()
    assert (row["prompt_tokens"], row["completion_tokens"], row["outcome"]) == (7, 2, "success")
    client.reset()
    assert client.telemetry(spark).isEmpty()


def test_normalized_messages(spark):
    catalog = Catalog.of(shop(spark))
    said = [(1, "For that, what matters is: cotton.", "buying", 2), (2, "something with a lining of cotton please", "buying", 2), (3, "I'm still exploring", "browsing", 1), (4, None, "buying", 2), (5, "leather of some kind", "buying", 2)]
    m = spark.createDataFrame(said, "query_id long, message string, scenario string, turn int")
    indexes = catalog.keys, catalog.materials, catalog.prices
    rules = {(r["query_id"], r["constraint"]) for r in llm_hooks.normalized(m, *indexes).collect()}
    assert rules == {(1, "cotton")}

    def ask(system, user, most):
        return json.dumps({"constraints": [*json.loads(user)["catalog_candidates"], "made up"]})

    got = {(r["query_id"], r["constraint"], r["source"]) for r in llm_hooks.normalized(m, *indexes, ask=ask).collect()}
    assert (1, "cotton", "customer_reply") in got and {(2, "cotton", "model"), (2, "cotton lining", "model"), (5, "leather", "model")} <= got
    assert not [g for g in got if g[0] in (3, 4) or g[1] == "made up"]


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / "settings"
    file.write_text("# comment\nexport LODESTONE_DENSE='yes'\nLODESTONE_EXACT = off\nno line\nLODESTONE_BUCKET=perhaps\n")
    monkeypatch.setenv("LODESTONE_FRESHNESS", "0")
    assert settings.switch("LODESTONE_DENSE", None, False, str(file)) and not settings.switch("LODESTONE_DENSE", False, True, str(file)) and not settings.switch("LODESTONE_DENSE")
    config = Config.chosen(path=str(file))
    assert (config.exact_boost, config.bucket_boost, config.dense_weight, config.freshness) == (0.0, 0.10, 0.20, False)
    assert Config.chosen(freshness=True).freshness and settings.setting("LODESTONE_NONE", str(tmp_path / "none")) == ""


def test_loop_variants(spark):
    p = shop(spark)
    text = simulate.searchable_text(*[F.col(c) for c in ("title", "features", "details", "description", "categories", "store")])
    cards = p.select(F.col("doc_id").alias("target"), T.coarse_category(F.col("categories")).alias("category"), simulate.intent_card(F.col("title"), F.col("features"), F.col("details"), text, F.col("price")).alias("card"))
    samples = spark.createDataFrame([("s1", "buying", "A"), ("s2", "browsing", "B")], "sample_id string, scenario_type string, target string").join(cards, "target").withColumn("override", F.lit(None).cast("struct<turn:int,old_value:string,new_value:string,message:string>"))
    catalog = Catalog.of(p)
    seen, timings = [], []
    evaluate(samples, catalog, Config(turns=2), observe=lambda turn, step, frame: seen.append((turn, step)), timings=timings).collect()
    assert seen[:3] == [(1, "context"), (1, "pool"), (1, "top")] and timings[0]["sessions"] == 2 and timings[0]["seconds"] > 0
    told = transcripts(samples, catalog)
    assert set(told) == {"s1", "s2"} and "Customer: I'm looking for" in told["s1"] and "(target)" in told["s1"] and "Found in turn" in told["s1"]
    with pytest.raises(ValueError, match="more than 1"):
        transcripts(samples, catalog, most=1)

    replay = Replay(catalog, most=1)
    key = replay.start(samples.filter("sample_id = 's1'"))
    first = replay.step(key)
    assert first["message"].startswith("I'm looking for") and first["recommendations"][0][0] == 1 and first["constraints"] and replay.config()["products"] == 2
    while (turn := replay.step(key)) is not None:
        first = turn
    assert first["found"]["hit"] and replay.step(key) is None
    with pytest.raises(KeyError):
        replay.step("none")

    def similarity(queries, pool):
        return pool.withColumn("score", F.when(F.col("doc_id") == "B", 1.0).otherwise(0.5))

    swept = limit_sweep(samples, catalog, similarity, (1,)).filter("scenario_type IS NULL").collect()
    assert [(r["turn_limit"], r["sample_count"]) for r in swept] == [(1, 2)]
    near = spark.createDataFrame([("A", 0, "Red canvas shoe", ["Shoes"], [], [], [], "s", 1.0), ("B", 1, "Red canvas shoe", ["Shoes"], [], [], [], "s", 1.0)], PRODUCT)
    lost = suppressed_targets(samples.withColumn("target", F.lit("B")).filter("sample_id = 's2'").withColumn("category", F.lit("canvas shoe")), Catalog.of(near.unionByName(p.filter("doc_id = 'A'").withColumns({"doc_id": F.lit("C"), "ord": F.lit(2)}))), Config(diverse=0.8, top=2, turns=1))
    assert [(r["target"], r["suppressor"]) for r in lost.collect()] == [("B", "A")]


def test_numpy_draws_are_numpys(spark):
    rng = np.random.default_rng(9)
    n, replicates = 37, 50
    table = np.random.default_rng(1).random((n, 6))
    rows = spark.createDataFrame([(i, bool(r[0] > 0.5), float(r[1]), int(1 + 10 * r[2]) if r[0] > 0.5 else None, bool(r[3] > 0.5), float(r[4]), int(1 + 10 * r[5]) if r[3] > 0.5 else None) for i, r in enumerate(table)], "idx long, hit_a boolean, rr_a double, turn_a int, hit_b boolean, rr_b double, turn_b int")
    plain = rows.toPandas().fillna({"turn_a": 11, "turn_b": 11})
    idx = rng.integers(0, n, size=(replicates, n))

    def score(p, at):
        turn = plain[f"turn_{p}"].to_numpy(float)[at].mean(axis=1)
        return 0.5 * plain[f"hit_{p}"].to_numpy(float)[at].mean(axis=1) + 0.3 * plain[f"rr_{p}"].to_numpy()[at].mean(axis=1) + 0.2 * np.clip((11 - turn) / 10, 0, 1)

    got = [r["delta"] for r in resample.paired_bootstrap(rows, replicates, 9, n, draws="numpy").orderBy("b").collect()]
    assert np.allclose(got, score("a", idx) - score("b", idx))
    joined = resample._bootstrap_by_join(rows.withColumns({"hit_a": F.col("hit_a").cast("double"), "hit_b": F.col("hit_b").cast("double"), "turn_a": F.coalesce("turn_a", F.lit(11)), "turn_b": F.coalesce("turn_b", F.lit(11))}), resample.lcg_draws(spark, replicates, 9, n)).orderBy("b").collect()
    kernel = resample.paired_bootstrap(rows, replicates, 9, n).orderBy("b").collect()
    assert np.allclose([r["delta"] for r in joined], [r["delta"] for r in kernel])


def test_lcg_bootstrap_goes_around(spark, monkeypatch):
    """More draws than the generator has states: each state is drawn once, and replicates are differences of running sums."""
    for k, v in (("LCG_M", 1 << 18), ("LCG_REACH", 1 << 2), ("LCG_PARTS", 8)):
        monkeypatch.setattr(resample, k, v)
    rows = spark.createDataFrame([(i, i % 3 == 0, 1.0 / (1 + i), 1 + i, i % 2 == 0, 1.0 / (2 + i), 2 + i) for i in range(9)], "idx long, hit_a boolean, rr_a double, turn_a int, hit_b boolean, rr_b double, turn_b int")
    doubles = rows.withColumns({c: F.col(c).cast("double") for c in rows.columns if c != "idx"})
    for replicates, n in ((7, 100_003), (2, 300_001), (3, 2), (5, 9)):
        want = {r["b"]: r["delta"] for r in resample._bootstrap_by_join(doubles, resample.lcg_draws(spark, replicates, 77, n)).collect()}
        got = {r["b"]: r["delta"] for r in resample.paired_bootstrap(rows, replicates, 77, n).collect()}
        assert got.keys() == want.keys() and np.allclose([got[b] for b in want], list(want.values()), atol=1e-12)


def test_hooks():
    assert llm_hooks.normalized_constraints("m", ["x"], ["y"], lambda v: True, None) == ["x"]
    ask = lambda s, u, n: '```json\n["y", "made up"]\n```'
    assert llm_hooks.normalized_constraints("m", [], ["y"], lambda v: True, ask) == ["y"]
    assert llm_hooks.detects_override("ignore my earlier preference", None)
    assert not llm_hooks.detects_override("blue shoes", lambda *a: "true") and llm_hooks.detects_override("blue instead", lambda *a: "true")
    assert llm_hooks.explained("plain", lambda *a: "x" * 500) == "plain"
