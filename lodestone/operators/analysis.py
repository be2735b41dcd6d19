"""Analyses of catalogs, sessions and runs that combine other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import diverse_top_k, expand_pairs, near_duplicate_pairs

# Fixed values.
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
SCOPES = ("top10", "full")
# End of the fixed values.


def opening_analysis(openings: DataFrame, buckets: DataFrame) -> DataFrame:
    """openings (query_id, message, target): how many openings name a category, whose bucket exists, and holds the target."""
    asked = openings.select("query_id", "target", T.phrase_key(T.category_phrase(F.col("message"))).alias("phrase"))
    known = buckets.select("phrase").distinct().withColumn("known", F.lit(True))
    inside = buckets.select("phrase", F.col("doc_id").alias("target")).distinct().withColumn("inside", F.lit(True))
    rows = asked.join(known, "phrase", "left").join(inside, ["phrase", "target"], "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    parsed = F.col("phrase").isNotNull()
    has = F.coalesce("known", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("sessions"), count(parsed)("parsed"), count(~parsed)("not_parsed"),
        count(parsed & ~has)("without_bucket"), count(has & F.coalesce("inside", F.lit(False)))("target_inside"),
    )


def duplicate_prevalence(pools: DataFrame, threshold: float = 0.8, variant_sensitive: bool = False) -> DataFrame:
    """pools (pool_id, doc_id, title): pools with near-duplicates, pairs, and pairs per pool."""
    pairs = expand_pairs(*near_duplicate_pairs(pools, threshold, variant_sensitive))
    per = pools.select("pool_id").distinct().join(pairs.groupBy("pool_id").agg(F.count(F.lit(1)).alias("pairs")), "pool_id", "left").fillna(0, ["pairs"])
    return per.agg(F.count(F.lit(1)).alias("pools"), F.sum((F.col("pairs") > 0).cast("long")).alias("affected"), F.sum("pairs").alias("pairs"), F.avg("pairs").alias("mean_pairs"))


def similarity_sweep(pool: DataFrame, targets: DataFrame, k: int = 10, thresholds: tuple[float, ...] = THRESHOLDS, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """targets (query_id, target): recall and reciprocal rank of diverse top-k lists, for each threshold and scope."""
    out = None
    for scope in scopes:
        for threshold in thresholds:
            hit = diverse_top_k(pool, k, threshold, scope).join(targets, "query_id").filter("doc_id = target").select("query_id", (1.0 / F.col("rank")).alias("rr"))
            one = targets.select("query_id").join(hit, "query_id", "left").agg(
                F.lit(scope).alias("scope"), F.lit(threshold).alias("threshold"), F.avg(F.col("rr").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce("rr", F.lit(0.0))).alias("mrr")
            )
            out = one if out is None else out.unionByName(one)
    return out


def drain_turns(states: DataFrame) -> DataFrame:
    """states (session_id, turn, state) of plans.dialog: per scenario, in which turn sessions had nothing more to tell."""
    done = states.filter("state.other_exhausted").groupBy("session_id").agg(F.min("turn").alias("drain_turn"), F.max_by("state.scenario", "turn").alias("scenario"))
    return done.groupBy("scenario", "drain_turn").agg(F.count(F.lit(1)).alias("sessions"))


def router_accuracy(states: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (session_id, scenario_type): share of sessions whose last state names their scenario."""
    last = states.groupBy("session_id").agg(F.max_by("state.scenario", "turn").alias("scenario"))
    right = (F.col("scenario") == F.col("scenario_type")).cast("double")
    return last.join(truth, "session_id").groupBy("scenario_type").agg(F.count(F.lit(1)).alias("sessions"), F.avg(right).alias("accuracy"))


def slots_by_attribute(states: DataFrame) -> DataFrame:
    """(session_id, turn, attribute, values) of active constraints, in the order in which they were told."""
    each = states.select("session_id", "turn", F.posexplode("state.constraints").alias("at", "c")).filter("c.active")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("c.text").alias("text")))), lambda x: x["text"])
    return each.groupBy("session_id", "turn", F.col("c.attribute").alias("attribute")).agg(listed.alias("values"))
