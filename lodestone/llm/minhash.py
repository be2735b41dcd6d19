"""MinHash near-dedup with DartMinHash signatures.

Each element of a weighted set owns a region: its weight wide, and unbounded in rank. Darts
fall on it as a Poisson process, by hashes of the element and of the cell of the region, so
equal regions get equal darts. Each dart has a coordinate of the signature; the earliest
dart (smallest rank) in each coordinate is kept. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Cost follows the number of darts, not
elements times coordinates: ranks are thrown in levels of doubling width until every
coordinate has a dart.

Signatures are cut into bands; sets that share a band meet in a bucket. Within a bucket the
members are compared with one of them, by exact similarity, which connects most. Buckets that
are then still in several components are searched whole: signatures say which members of
different components may be alike, the exact similarity decides, and only links that join
components leave the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, byte_batches, drop_path, join_counted, lean, lean_group, mix64, scratch_path, shingle_hashes, text_bytes, word_hashes, written

COORDINATES, ROWS = 120, 5
FIRST_LEVEL = 2.0**-7
MOST = U64(0xFFFFFFFFFFFFFFFF)
#: Candidate sets are picked by a broadcast of their ids up to this many (16 bytes each), and by a shuffle beyond.
MOST_BROADCAST = 250_000
#: Buckets that stay in several components are searched as one group up to this many members and shingles, and by pairs of blocks beyond; see _in_blocks.
MOST_MEMBERS, MOST_SHINGLES = 2_000, 8_000_000
#: How far below the threshold, in standard deviations, the signatures' estimate of a pair may be that is still checked.
MARGIN = 5.0


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of the Poisson distribution, up to where the rest is below 2**-53."""
    from math import exp, lgamma, log

    top = int(mean + 12 * mean**0.5 + 30)
    p = np.array([exp(-mean + i * log(mean) - lgamma(i + 1)) for i in range(top)])
    return np.cumsum(p)


def signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """Signatures (n_rows, k) of sets given as element hashes and the row each is in; weights are 1 unless given.

    Rows without elements keep the largest value everywhere.
    """
    if weights is not None:
        cells = np.ceil(weights).astype(np.int64)
        source = np.repeat(np.arange(len(elements)), cells)
        cell = np.arange(len(source)) - np.repeat(np.cumsum(cells) - cells, cells)
        left = weights[source] - cell  # how much of the cell is in the region
        elements, rows = mix64(elements[source] + U64(0x51_7C_C1_B7) * cell.astype(U64)), rows[source]
    out = np.full(n_rows * k, MOST, U64)
    has = np.zeros(n_rows, bool)
    has[rows] = True
    level, low, width = 0, 0.0, FIRST_LEVEL
    while len(elements):
        seed = U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = mix64(elements ^ seed)
        table = _poisson_table(width)
        u = (h >> U64(11)).astype(np.float64) * 2.0**-53
        if width < 0.5:
            thrown = np.flatnonzero(u >= table[0])
            counts = np.searchsorted(table, u[thrown], side="right")
        else:
            thrown, counts = np.arange(len(h)), np.searchsorted(table, u, side="right")
        source = np.repeat(thrown, counts)
        number = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        dart = mix64(h[source] + (number.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03))
        if weights is not None:
            inside = (mix64(dart ^ U64(0xABCD)) >> U64(11)).astype(np.float64) * 2.0**-53 < left[source]
            dart, source = dart[inside], source[inside]
        rank = mix64(dart)
        key = rows[source] * k + (dart % U64(k)).astype(np.int64)
        best = np.full(n_rows * k, MOST, U64)
        np.minimum.at(best, key, rank)
        new = (out == MOST) & (best != MOST)
        out[new] = mix64(best[new] ^ seed)
        need = has & (out.reshape(n_rows, k) == MOST).any(axis=1)
        going = need[rows]
        elements, rows = elements[going], rows[going]
        if weights is not None:
            left = left[going]
        low, width, level = low + width, low + width, level + 1
    return out.reshape(n_rows, k)


def band_hashes(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash per band of so many coordinates."""
    n, k = sig.shape
    bands = sig.reshape(n, k // rows, rows)
    out = np.broadcast_to(np.arange(k // rows, dtype=U64) + U64(1), (n, k // rows)).copy()
    for i in range(rows):
        out = mix64(out ^ bands[:, :, i]) + U64(i)
    return out


def shingle_sets(column, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column, end to end, how often each stands in its text, and the rows' bounds."""
    sh, bounds = shingle_hashes(*word_hashes(*text_bytes(column)), k)
    sets = [np.unique(sh[a:b], return_counts=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    out = np.zeros(len(bounds), np.int64)
    np.cumsum([len(s) for s, _ in sets], out=out[1:])
    if not sets:
        return np.zeros(0, U64), np.zeros(0, np.int64), out
    return np.concatenate([s for s, _ in sets]), np.concatenate([n for _, n in sets]), out


def unfold(sets: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: an element of weight n becomes n elements. Their Jaccard similarity is the weighted one."""
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix64(np.repeat(sets, counts) + number.astype(U64)), np.concatenate([[0], np.cumsum(counts)])[bounds]


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A 128-bit key of each whole set, from two independent sums: texts with equal sets have equal keys."""
    out = []
    for seed in (0x5BD1E995, 0xC6A4A7935BD1E995):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(sets ^ U64(seed)))])
        out.append(mix64((total[bounds[1:]] - total[bounds[:-1]]) ^ np.diff(bounds).astype(U64)))
    data = np.stack(out, axis=1).astype("<u8").tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


def sign(docs: DataFrame, k: int = 5, weighted: bool = False) -> DataFrame:
    """docs has id, text_key and text. Returns id, text_key, key (of the shingle set), shingles (how many), bands, and 16 bits of each coordinate."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            sets, counts, bounds = shingle_sets(batch.column(2), k)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            sig = signatures(sets, rows, batch.num_rows, counts.astype(np.float64) if weighted else None)
            if weighted:
                sets, bounds = unfold(sets, counts, bounds)
            bands, short = band_hashes(sig).astype(np.int64), (sig & U64(0xFFFF)).astype("<u2")
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(set_keys(sets, bounds), pa.binary()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())), pa.array([r.tobytes() for r in short], pa.binary())],
                names=["id", "text_key", "key", "shingles", "bands", "sig"],
            )

    return docs.select("id", "text_key", "text").mapInArrow(lean(run), f"id {kind}, text_key binary, key binary, shingles long, bands array<long>, sig binary")


def set_table(docs: DataFrame, k: int = 5, weighted: bool = False) -> DataFrame:
    """docs has class, key and text. Returns class and set: 32 bits of each shingle's hash; rows whose text has another key are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            sets, counts, bounds = shingle_sets(batch.column(2), k)
            if weighted:
                sets, bounds = unfold(sets, counts, bounds)
            short = (sets >> U64(32)).astype(np.uint32).view(np.int32)
            column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(short))
            mine = pa.array([a == b for a, b in zip(set_keys(sets, bounds), batch.column(1).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["class", "set"]).filter(mine)

    return docs.select("class", "key", "text").mapInArrow(lean(run), "class long, set array<int>")


class _Tables:
    """Parquet tables in the shared folder, deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.spark, path)


def components(edges: DataFrame, tables: _Tables) -> DataFrame:
    """Connected components of edges (a, b): node, label (the smallest node), for nodes that have edges.

    Each round takes the smallest label among the neighbours' and then the label of that label, so labels
    spread at doubling speed; it ends when nothing changes. A round reads and writes tables of the edges' size.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    labels = tables.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = new.join(jump, "next", "left").select("node", F.least("next", "beyond").alias("label"), F.col("label").alias("was"))
        new = tables.keep(new, "labels")
        labels = new.select("node", "label")
        if new.filter("label != was").isEmpty():
            return labels


def _leaders(member: DataFrame, tables: _Tables) -> DataFrame:
    """member (bucket, class, component). Pairs (a, b): the smallest set of each component of a bucket, with the smallest of the bucket.

    A bucket of n components gives n-1 pairs.
    """
    one = tables.keep(member.groupBy("bucket", "component").agg(F.min("class").alias("class")), "one")
    lead = tables.keep(one.groupBy("bucket").agg(F.min("class").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "lead")
    return join_counted(one, lead, ["bucket"]).filter("class != lead").select(F.least("class", "lead").alias("a"), F.greatest("class", "lead").alias("b")).distinct()


def _in_blocks(member: DataFrame) -> DataFrame:
    """member (bucket, class, component, members, shingles), with block, low and high: the groups (bucket, low, high) to search.

    A bucket of up to MOST_MEMBERS and MOST_SHINGLES is one group. A larger one is dealt into blocks of half as many by
    a hash, and each pair of blocks, and each block by itself, is a group, so that every pair of members meets in
    exactly one group.
    """
    fill = F.greatest(F.col("members") / MOST_MEMBERS, F.col("shingles") / MOST_SHINGLES)
    blocks = F.when(fill <= 1, F.lit(1)).otherwise(F.ceil(fill * 2).cast("int"))
    dealt = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("bucket", "class", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets are similar."""
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("double")
    a = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    both = a.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.filter(F.least(F.size("set_a"), F.size("set_b")) >= threshold * F.greatest(F.size("set_a"), F.size("set_b")))
    return both.filter(shared >= threshold * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def joining_links(component: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], threshold: float, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join what can be joined: a pair that is connected already is not looked at.

    Given block, only pairs of different blocks are looked at.
    """
    k = sig.shape[1]
    least = threshold * k - MARGIN * (k * threshold * (1 - threshold)) ** 0.5
    sizes = np.array([len(s) for s in sets])
    root = np.unique(component, return_inverse=True)[1]
    out = []
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if block is not None:
            rest = rest[block[rest] != block[i]]
        if not len(rest):
            continue
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= threshold * np.maximum(sizes[rest], sizes[i])]
        alike = rest[(sig[rest] == sig[i]).sum(axis=1) >= least]
        for j in alike.tolist():
            if root[j] != root[i]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= threshold * (sizes[i] + sizes[j] - shared):
                    out.append((i, j))
                    root[root == root[j]] = root[i]
    return out


def _search_buckets(member: DataFrame, threshold: float) -> DataFrame:
    """member (bucket, low, high, block, class, component, sig, set): links (a, b) that join components within a bucket."""

    def run(table):
        import pyarrow as pa

        cls = table.column("class").to_numpy()
        order = np.argsort(cls, kind="stable")
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(cls), -1)[order]
        column = table.column("set").combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        sets = [values[offsets[i] : offsets[i + 1]] for i in order.tolist()]
        apart = table.column("low")[0] != table.column("high")[0]
        block = table.column("block").to_numpy()[order] if apart else None
        found = joining_links(table.column("component").to_numpy()[order], sig, sets, threshold, block)
        cls = cls[order]
        a, b = cls[[f[0] for f in found]], cls[[f[1] for f in found]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return member.groupBy("bucket", "low", "high").applyInArrow(lean_group(run), "a long, b long").distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, k: int, weighted: bool) -> DataFrame:
    """id (known, id), text_key, n_links, class_id (like id), first (id and text_key of the row that stands for the group): one row per row of docs."""
    spark = docs.sparkSession
    tables = _Tables(spark)
    src = _keyed(docs, id_col, text_col)
    signed = tables.keep(sign(src, k, weighted), "signed")
    first = [F.first(c).alias(c) for c in ("bands", "sig")]
    classes = signed.groupBy("key").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("shingles").alias("shingles"), *first)
    # classes go by a number, fixed when the table is written
    classes = tables.keep(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    # an empty set has no band
    banded = classes.filter("shingles > 0").select("class", "shingles", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("shingles").alias("shingles")).filter("members > 1")
    full = tables.keep(full, "full")
    buckets = tables.keep(join_counted(banded.drop("shingles"), full, ["bucket"], "members"), "buckets")
    wanted = buckets.select("class").distinct().join(classes.select("class", "key", "first.*"), "class")
    wanted = tables.keep(wanted, "wanted")
    n = wanted.count()
    picked = src.join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, ["id", "text_key"])
    # rows that repeat are one set
    sets = tables.keep(set_table(picked, k, weighted).dropDuplicates(["class"]), "sets")

    edges = tables.keep(_linked(_leaders(buckets.withColumn("component", F.col("class")), tables), sets, threshold), "links")
    label = tables.keep(components(edges, tables).withColumnRenamed("node", "class"), "label")

    def members() -> DataFrame:
        return buckets.join(label, "class", "left").withColumn("component", F.coalesce("label", "class")).drop("label")

    apart = members().groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("bucket", "n")
    open_ = tables.keep(join_counted(members(), tables.keep(apart, "apart"), ["bucket"]).drop("n"), "open")
    inside = _in_blocks(open_).join(sets, "class").join(classes.select("class", "sig"), "class")
    more = tables.keep(_search_buckets(inside, threshold), "links")
    if not more.isEmpty():
        edges = edges.union(more)
        label = components(edges, tables).withColumnRenamed("node", "class")
    degree = edges.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("class", "key", "first", "copies").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    leaders = tables.keep(named.groupBy("label").agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("n")), "leaders")
    grouped = join_counted(named.select("class", "key", "copies", "label"), leaders, ["label"]).join(degree, "class", "left")
    grouped = tables.keep(grouped.select("key", "copies", F.col("leader").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "grouped")
    out = join_counted(signed.select("id", "text_key", "key"), grouped, ["key"], "copies").select("id", "text_key", "n_links", F.col("first.id").alias("class_id"), "first")
    out = written(out, "groups")
    tables.drop()
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (a struct, so that null ids have a place, before all others), text_key (a digest of the text) and text."""
    identity = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).cast("long").alias("id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(identity.alias("id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5, weighted: bool = False) -> DataFrame:
    """Returns id_col, class_id and n_links: one row per document.

    class_id is the smallest id of the documents that links connect; a link is a Jaccard similarity of the sets of
    k-word shingles of threshold or more. Words are lower-case (ASCII) runs without white space. Documents with
    equal sets are copies and are taken together first; n_links counts the links found of a document's set to other
    sets (as many as connect them, not all). weighted: a shingle counts as often as it stands in the text, in the
    signatures (as the element's weight) and in the similarity.

    Texts of fewer than k words have one shingle of all their words. Null and empty texts are copies of each other.
    Null ids count as smaller than all others. Rows that repeat an id are grouped each by its own text. Empty table: no
    rows. Other columns are ignored.

    Scale: copies collapse before anything is joined. A bucket is first reduced to a representative on the map side, so
    that n sets give n-1 pairs, never n*n. What stays apart is searched whole; a bucket of more than MOST_MEMBERS sets
    or MOST_SHINGLES is searched by pairs of blocks in groups of bounded size, each set being sent once for every block.
    Buckets and classes that hold a large share of the rows are joined by broadcast of their few keys. Only counts
    reach the driver.
    """
    out = _groups(docs, id_col, text_col, threshold, k, weighted)
    return out.select(F.col("id.id").alias(id_col), F.col("class_id.id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 5) -> DataFrame:
    """docs without those that near_duplicates groups with a smaller id: of each group one row stays, with all its columns as they are.

    It is the row of the smallest id (null ids first), and, where several texts of a group have that id, of the smallest
    digest; of rows that repeat both id and text any one stays. Rows of one id whose texts are not alike all stay.
    """
    groups = _groups(docs, id_col, text_col, threshold, k, False)
    lost = groups.filter(F.struct("id", "text_key") != F.col("first")).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    lost = F.broadcast(lost) if lost.count() <= MOST_BROADCAST else lost
    identity = F.struct(docs[f"`{id_col}`"].isNotNull().alias("known"), docs[f"`{id_col}`"].cast("long").alias("id"))
    digest = F.unhex(F.md5(F.coalesce(docs[f"`{text_col}`"], F.lit(""))))
    left = docs.join(lost, (identity == F.col("_id")) & (digest == F.col("_key")), "left_anti")
    twice = groups.filter(F.struct("id", "text_key") == F.col("first")).groupBy("id", "text_key").count().filter("count > 1")
    if not twice.isEmpty():
        mark = "_text_digest_"
        left = left.withColumn(mark, digest).dropDuplicates([id_col, mark]).drop(mark)
    return left
