"""Document fingerprints (native): threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so sketches of
any two documents are samples by the same rule: they merge by union, and containment and
resemblance are estimated by counting, also between a short and a very long document. A
short text's sketch may be empty; a fingerprint therefore has a digest of the text besides,
by which equal texts are known. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SHINGLE = 5
#: Hashes below 2**-FRACTION_BITS of the space are kept. Half of them: most documents are short.
FRACTION_BITS = 1
#: A range of ids holds about so many bytes of text.
RANGE_BYTES = 32_000_000


def _threshold(fraction_bits: int) -> int:
    return -(1 << 63) + (1 << (64 - fraction_bits))


def with_sketch(df: DataFrame, text: str, out: str, k: int = SHINGLE, fraction_bits: int = FRACTION_BITS) -> DataFrame:
    """Adds out: the sorted distinct hashes of text's k-word shingles below 2**-fraction_bits of the space.

    Words are lower-case runs without white space. A text of fewer than k words has one shingle, of
    all its words. Null and empty texts have the shingle of no words, whose hash is the smallest there is.
    """
    bare = F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    df = df.withColumn("_words", F.split(bare, r"\s+"))
    df = df.withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    w = F.col("_w")
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    none = F.array(F.lit(-(1 << 63)))
    df = df.withColumn("_s", F.when(F.size(w) >= k, runs).when(F.col("_words")[0] == "", none).otherwise(F.array(F.xxhash64(w)))).drop("_w", "_words")
    low = F.filter("_s", lambda h: h < F.lit(_threshold(fraction_bits)))
    return df.withColumn(out, F.sort_array(F.array_distinct(low))).drop("_s")


def text_digest(text: Column) -> Column:
    """By which equal texts are known; null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _digits(h: Column) -> Column:
    return F.lpad(F.hex(h), 16, "0")


def as_text(digest: Column, sketch: Column) -> Column:
    """The digest in hex, a colon, and the sketch's hashes in order, eight bytes each, in base 64."""
    return F.concat(_digits(digest), F.lit(":"), F.base64(F.unhex(F.array_join(F.transform(sketch, _digits), ""))))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def resemblance(a: Column, b: Column) -> Column:
    """Estimate of the shingle sets' Jaccard similarity; 0 where both sketches are empty and so say nothing."""
    return F.coalesce(F.try_divide(shared(a, b), F.size(a) + F.size(b) - shared(a, b)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has; 0 where a's sketch is empty."""
    return F.coalesce(F.try_divide(shared(a, b), F.size(a)), F.lit(0.0))


def likeness(estimate: Column, a: Column, b: Column) -> Column:
    """The estimate, or 1 for texts of equal digests a and b."""
    return F.when(a == b, 1.0).otherwise(estimate)


def _range_buckets(ids: DataFrame, n: int) -> Column:
    """A bucket number that grows with id: quantile ranges, each cut into equal widths."""
    coarse = min(n, 128)
    cuts = ids.select(F.percentile_approx("id", [i / coarse for i in range(coarse + 1)], 10_000)).first()[0]
    low, high = F.lit(cuts[0]), F.lit(cuts[-1])
    edges = sorted(set(cuts))
    fine = -(-n // coarse)
    rank = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda e: e <= F.col("id")))
    low = F.coalesce(F.get(F.array(*[F.lit(x) for x in edges]), rank - 1), F.lit(edges[0]))
    high = F.coalesce(F.get(F.array(*[F.lit(x) for x in edges]), rank), F.lit(edges[-1]))
    part = F.floor((F.col("id").cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)) * fine)
    return (rank * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))).cast("long")


def with_next(docs: DataFrame, tie: str, partitions: int | None, make=lambda rows: rows, carry: tuple[str, ...] = ()) -> DataFrame:
    """make(rows) with next added: a struct of the carry columns of the row that follows by id (after the last: the first).

    docs has a long column id, without nulls, and tie, a column of text. Rows are dealt to ranges of ids, each of about
    RANGE_BYTES of text unless partitions says how many; the first row of a range also goes to the range before it, so
    that a window inside each range sees every successor. Rows of one id follow each other by tie. make adds columns
    to the dealt rows, so these need not travel.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(tie)).alias("bytes")).first()
    if not size["rows"]:
        return make(docs).withColumn("next", F.struct(*carry))
    if partitions is None:
        partitions = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["bytes"] // RANGE_BYTES)
    docs = docs.withColumn("bucket", _range_buckets(docs.select("id"), partitions))
    firsts = sorted((r["bucket"], r["first_id"]) for r in docs.groupBy("bucket").agg(F.min("id").alias("first_id")).collect())
    # as many rows as ranges: bounded by the number of partitions
    before = docs.sparkSession.createDataFrame(
        [(b, f, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)], "bucket long, first_id long, previous long"
    )
    docs = docs.join(F.broadcast(before), "bucket")
    places = F.array(
        F.struct(F.col("bucket").alias("at"), F.lit(False).alias("guest")),
        F.when(F.col("id") == F.col("first_id"), F.struct(F.col("previous").alias("at"), F.lit(True).alias("guest"))),
    )
    docs = docs.withColumn("place", F.explode(places)).filter(F.col("place").isNotNull())
    docs = docs.select("*", "place.at", "place.guest").drop("place", "bucket", "first_id", "previous")
    order = ["guest", "id", tie]
    dealt = docs.repartition(partitions, "at").sortWithinPartitions("at", *order)
    window = Window.partitionBy("at").orderBy(*order)
    rows = make(dealt).withColumn("next", F.lead(F.struct(*carry)).over(window))
    return rows.filter(~F.col("guest")).drop("at", "guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, fraction_bits: int = FRACTION_BITS, partitions: int | None = None) -> DataFrame:
    """Sketches every text and its edited text: the last quarter replaced by the start of the next document.

    Returns id_col, text, edited, sketch, edited_sketch, next_sketch, digest, edited_digest, next_digest. The next
    document is the one with the next larger id; rows of one id follow each other by text; null ids come first (with
    those of the smallest id a long can have, by text). A single document follows itself. Null texts are empty. Empty
    table: no rows. Other columns are ignored.

    Scale: the text moves once, dealt by ranges of ids; sketches are made where it lands. Only range bounds reach the
    driver. Many rows of one id stay in one range.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(src, "text", partitions, lambda df: with_sketch(df, "text", "sketch", k, fraction_bits).withColumn("digest", text_digest(F.col("text"))), ("text", "sketch", "digest"))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next.text", F.lit(1), cut))
    rows = rows.select("key", "text", "sketch", "digest", edited.alias("edited"), F.col("next.sketch").alias("next_sketch"), F.col("next.digest").alias("next_digest"))
    rows = with_sketch(rows, "edited", "edited_sketch", k, fraction_bits).withColumn("edited_digest", text_digest(F.col("edited")))
    return rows.select(F.col("key").alias(id_col), "text", "edited", "sketch", "edited_sketch", "next_sketch", "digest", "edited_digest", "next_digest")
