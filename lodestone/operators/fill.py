"""Filling lists of recommendations up with products that were not shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_k

PLACEHOLDER = "__missing_catalog_"


def start_of(seed: str, key: Column, turn: Column, n: int) -> Column:
    """A place from 0 to n-1 that follows from a digest of seed, key and turn."""
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), key, turn.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(n))


def recommendations(requests: DataFrame, found: DataFrame, catalog: DataFrame, shown: DataFrame, k: int = 10, seed: str = "") -> DataFrame:
    """requests (query_id, key, turn); found (query_id, doc_id, rank); catalog (doc_id, position from 0 on, see ordering.numbered); shown (query_id, doc_id).

    Returns (query_id, doc_id, rank), k rows for each request: what was found, is in the catalog and was not shown; then products not
    shown, as they follow each other in the catalog from a place that a digest picks; then such as were shown; then placeholders.

    A walk of k and as many steps as may be wasted is enough, so each request meets that many products by a join on their
    positions, never the whole catalog.
    """
    size = catalog.count()
    known = catalog.select("doc_id")
    hits = found.join(known, "doc_id", "left_semi").join(shown.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    hits = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("place"))
    rows = hits.select("query_id", "doc_id", F.lit(0).alias("class"), F.col("place").cast("long").alias("place"))
    if size:
        taken = shown.select("query_id", "doc_id").unionByName(hits.select("query_id", "doc_id")).distinct()
        wasted = taken.groupBy("query_id").agg(F.count(F.lit(1)).alias("wasted"))
        walk = requests.join(wasted, "query_id", "left").withColumn("steps", F.least(F.lit(size), F.coalesce("wasted", F.lit(0)) + k))
        walk = walk.select("query_id", F.posexplode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("place", "step"), start_of(seed, F.col("key"), F.col("turn"), size).alias("start"))
        met = walk.withColumn("position", F.pmod(F.col("start") + F.col("step"), F.lit(size))).join(catalog.select("doc_id", "position"), "position")
        met = met.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        met = met.join(shown.select("query_id", "doc_id").distinct().withColumn("old", F.lit(1)), ["query_id", "doc_id"], "left")
        rows = rows.unionByName(met.select("query_id", "doc_id", (F.coalesce("old", F.lit(0)) + 1).alias("class"), F.col("place").cast("long").alias("place")))
    slots = requests.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"))
    rows = rows.unionByName(slots.select("query_id", F.concat(F.lit(PLACEHOLDER), F.col("place").cast("string")).alias("doc_id"), F.lit(3).alias("class"), F.col("place").cast("long").alias("place")))
    return top_k(rows, k, ["query_id"], [F.asc("class"), F.asc("place"), F.asc("doc_id")]).select("query_id", "doc_id", "rank")
