"""Line dedup (native): drop lines whose key stands in many documents.

Lines are exploded and hashed, distinct documents are counted per hash, lines over the
threshold go, and the rest is put together again by position. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

#: Keys over the threshold go to the lines by broadcast up to this many (about 40 bytes each).
MOST_BROADCAST = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; other characters as they are."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key: two independent 64-bit hashes (the second starts from another seed)."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns id_col, text (what is left), n_lines, n_dropped and the columns keep: one row per document.

    A key of min_chars code points or more that stands in min_docs documents or more loses all
    its lines but those of the largest id that has it. Shorter keys are never dropped.

    Null or empty text: one empty line, kept. Empty table: no rows. Other columns are ignored,
    whatever their names. Rows with a null id keep all their lines and count for no key. Rows that
    repeat an id count as one document for the counts, and each row is cut and returned.

    Scale: the count combines on the map side, so a line in every document costs one row per task; only keys over
    the threshold go on, as a table in the shared folder. Their lines are found by broadcast where they are few, else
    by join_counted, which splits off the keys that hold a large share of the lines. Lines to drop are gathered by
    position per document, which bounds a group by the lines of one document. The text moves once, to meet them.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"))
    lines = F.split("text", "\n", -1)
    keys = F.transform(lines, line_key)
    known = src.filter(F.col("id").isNotNull())
    key = F.explode(F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars)))
    keyed = known.select("id", key.alias("key")).select("id", *_hashes(F.col("key")))
    if not src.groupBy("id").count().filter("count > 1").isEmpty():
        keyed = keyed.distinct()  # an id that stands in several rows is one document
    common = written(keyed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "lines")
    # rows of one id and text are cut alike
    doc = ["id", "text_hash"]
    placed = known.select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(keys).alias("pos", "key")).filter(F.length("key") >= min_chars)
    placed = placed.select(*doc, "pos", *_hashes(F.col("key")))
    if common.count() <= MOST_BROADCAST:
        found = placed.join(F.broadcast(common), ["a", "b"])
    else:
        found = join_counted(written(placed, "placed"), common, ["a", "b"])
    drops = found.filter(F.col("id") < F.col("keeper")).groupBy(*doc).agg(F.collect_set("pos").alias("drop"))
    joined = src.withColumn("text_hash", F.xxhash64("text")).join(drops, doc, "left").withColumn("lines", lines)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    out = joined.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i))))
    return out.select(
        F.col("id").alias(id_col),
        F.array_join("kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        *(["row.*"] if keep else []),
    )
