"""Suffix-array dedup of repeated byte strings across documents.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Sorting
all suffixes of a corpus in one array does not scale, so shards are cut such that equal
strings always meet: every string of `length` bytes holds an anchor, a gram picked by its
content alone (the smallest hash in the window), and shares it with its copies. An anchor's
context is the stretch that all strings holding it cover. Contexts that are equal as a whole
(by 128 bits of a strong digest) are counted, not sorted; of what remains, anchors that occur
with different contexts, each shard sorts the contexts' suffixes by induced sorting and reads
repeats off the permuted common prefixes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_batches, drop_path, join_counted, lean, lean_group, mix64, scratch_path, text_bytes, worker_store
from .suffix_array import common_prefixes, suffix_array

GRAM = 128
#: Odd numbers; the second makes an independent hash of the first's strings.
BASE, OTHER_BASE = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
#: Documents are picked by a broadcast of their keys up to this many (16 bytes each), by a shuffle beyond.
MOST_BROADCAST = 250_000
#: An anchor with more different contexts than this is not gathered in one shard; see _windows.
MOST_CONTEXTS = 8192
SHARD_BYTES = 1_000_000
#: Bytes of text that a worker looks at together.
BATCH_BYTES = 500_000
SEPARATOR = 255
#: The columns of a context's digest.
CONTEXT = ("context_a", "context_b")


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base to the power i, and its inverse, modulo 2**64."""
    store = worker_store()
    have = store.get(("gram powers", base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = store["gram powers", base] = tuple(out)
    return have[0][:n], have[1][:n]


def _prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    powers, _ = _powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    _, inverse = _powers(len(prefix), base)
    return (prefix[end] - prefix[start]) * inverse[start]


def _slide(x: np.ndarray, w: int, what) -> np.ndarray:
    """Minimum or maximum of each w values in a row, from prefixes and suffixes of blocks of w."""
    n = len(x) - w + 1
    fill = np.iinfo(np.uint64).max if what is np.minimum else 0
    size = -(-len(x) // w) * w
    blocks = np.full(size, fill, U64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    left = what.accumulate(blocks, axis=1).ravel()
    right = what.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return what(right[:n], left[w - 1 : w - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Anchors of all rows of a byte buffer: row, position in the row, hash of the gram, digest of the context (two columns), and the context's end."""
    w = length - gram + 1
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(data) < length or not (sizes >= length).any():
        return none, none, none, np.zeros((0, 2), np.int64), none
    prefix = _prefix(data)
    grams = len(data) - gram + 1
    _, inverse = _powers(len(prefix), BASE)
    h = mix64((prefix[gram:] - prefix[:grams]) * inverse[:grams])
    # the last one wins among equals; it depends on places in the window alone
    rank = (h | U64(0xFFFFFFFF)) - np.arange(grams, dtype=U64)
    least = _slide(rank, w, np.minimum)
    # windows inside one row
    inside = np.zeros(len(least) + 1, np.int64)
    whole = sizes >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[:-1][whole] + sizes[whole] - length + 1, -1)
    least[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.concatenate([np.zeros(w - 1, U64), least, np.zeros(w - 1, U64)])
    at = np.flatnonzero(_slide(padded, w, np.maximum)[:grams] == rank)
    row = np.searchsorted(offsets, at, side="right") - 1
    start, end = np.maximum(at - (w - 1), offsets[row]), np.minimum(at + length, offsets[row + 1])
    view = memoryview(data)
    each = zip(start.tolist(), end.tolist(), (at - start).tolist(), strict=True)
    digests = b"".join([blake2b(view[a:b], digest_size=16, salt=place.to_bytes(8, "little")).digest() for a, b, place in each])
    context = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return row, at - offsets[row], h[at].astype(np.int64), context, end - offsets[row]


def _anchor_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", BATCH_BYTES):
            row, at, h, context, end = anchors_of(*text_bytes(batch.column(2)), length, gram)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(h, pa.int64()), *[pa.array(c, pa.int64()) for c in context.T], pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32))],
                names=["id", "digest", "anchor", *CONTEXT, "at", "end"],
            )

    return docs.select("id", "digest", "text").mapInArrow(lean(run), "id long, digest long, anchor long, context_a long, context_b long, at int, end int")


def _cut_contexts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs has id, digest, text and places (shard, at). Returns shard, id, digest, start, bytes: contexts of one shard that overlap are one."""
    back = length - gram

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", BATCH_BYTES):
            out: list[tuple] = []
            for key, digest, text, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode()
                spans: dict[int, list[list[int]]] = {}
                for place in sorted(places, key=lambda p: (p["shard"], p["at"])):
                    a, b = max(0, place["at"] - back), min(len(data), place["at"] + length)
                    own = spans.setdefault(place["shard"], [])
                    if own and a <= own[-1][1]:
                        own[-1][1] = b
                    else:
                        own.append([a, b])
                out += [(shard, key, digest, a, data[a:b]) for shard, own in spans.items() for a, b in own]
            kinds = [("shard", pa.int64()), ("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return docs.select("id", "digest", "text", "places").mapInArrow(lean(run), "shard long, id long, digest long, start int, bytes binary")


def repeats_of(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the runs of places where a string of length bytes starts that also starts elsewhere in the segments."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(bytes([SEPARATOR]).join(segments), np.uint8)
    if len(text) < length:
        return []
    sa = suffix_array(text, 256)
    shared = common_prefixes(text, sa)
    ordered = shared[sa]
    # with the one before or the one after
    ordered[:-1] = np.maximum(ordered[:-1], ordered[1:])
    best = np.empty(len(text), np.int64)
    best[sa] = ordered
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    owner = np.searchsorted(starts, np.arange(len(text)), side="right") - 1
    left = starts[owner] + sizes[owner] - np.arange(len(text))
    hit = np.flatnonzero((best >= length) & (left >= length))
    if not len(hit):
        return []
    cut = np.flatnonzero((np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])) + 1
    first, last = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
    own = owner[first]
    return list(zip(own.tolist(), (first - starts[own]).tolist(), (last - starts[own] + length).tolist(), strict=True))


def _sort_shards(segments: DataFrame, length: int) -> DataFrame:
    def run(table):
        import pyarrow as pa

        found = repeats_of(table.column("bytes").to_pylist(), length)
        who = pa.array([f[0] for f in found], pa.int64())
        start = table.column("start").combine_chunks().to_numpy(zero_copy_only=False)
        at = np.array([f[0] for f in found], np.int64)
        low = start[at] + np.array([f[1] for f in found], np.int64) if found else np.zeros(0, np.int64)
        high = start[at] + np.array([f[2] for f in found], np.int64) if found else np.zeros(0, np.int64)
        return pa.table({"id": table.column("id").take(who), "digest": table.column("digest").take(who), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})

    return segments.groupBy("shard").applyInArrow(lean_group(run), "id long, digest long, low int, high int")


def _windows(segments: DataFrame, length: int) -> DataFrame:
    """Repeats among contexts of anchors that are too frequent for one shard: each string of length bytes is counted by two independent hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, digest, start, data in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "digest", "start", "bytes")], strict=True):
                buffer = np.frombuffer(data, np.uint8)
                n = len(buffer) - length + 1
                if n > 0:
                    at = np.arange(n)
                    h = [mix64(_span_hash(_prefix(buffer, base), at, at + length, base)).astype(np.int64) for base in (BASE, OTHER_BASE)]
                    columns = [*h, np.full(n, key), np.full(n, digest), (start + at).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "id", "digest", "low"])

    each = segments.mapInArrow(lean(run), "a long, b long, id long, digest long, low int").distinct()
    common = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    return each.join(common, ["a", "b"]).select("id", "digest", "low", (F.col("low") + length).alias("high"))


def _cut_out(docs: DataFrame) -> DataFrame:
    """docs has key, text and marks (low, high). Returns key, n_bytes, spans, kept."""

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text", BATCH_BYTES):
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                merged: list[list[int]] = []
                for low, high in sorted((m["low"], m["high"]) for m in marks):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                sizes.append(len(data))
                spans.append([{"low": a, "high": b} for a, b in merged])
                edges = [0, *[x for m in merged for x in m], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["key", "n_bytes", "spans", "kept"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text", "marks").mapInArrow(lean(run), f"key {kind}, n_bytes long, spans array<struct<low:int,high:int>>, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = GRAM) -> DataFrame:
    """Returns id_col, n_bytes, spans (the maximal removed runs), kept (the remaining bytes): one row per document.

    Strings are judged on the input; they may overlap and lie in one document. Null texts are empty. Null ids are
    allowed. Rows that repeat, with or without the same id, are each other's copies. Empty table: no rows. Other columns
    are ignored.

    Scale: a document gives about one anchor per (length-gram)/2 bytes. Anchors that occur once are dropped by a count
    that combines on the map side; whole contexts that occur more than once are settled by counting, and one of each
    goes on. Anchors and contexts that hold a large share of the rows meet their counts by broadcast. A shard holds about
    SHARD_BYTES; an anchor with more than MOST_CONTEXTS different contexts is counted string by string instead, so that
    no group is gathered without bound. Marks of a document are bounded by its length.
    """
    spark = docs.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    src = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    doc = ["id", "digest"]
    anchors = keep(_anchor_table(src.filter(F.octet_length("text") >= length), length, gram), "anchors")
    several = keep(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    shared = keep(join_counted(anchors, several, ["anchor"]).drop("n"), "shared")
    contexts = keep(shared.groupBy("anchor", *CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "digest", "at")).alias("one")), "contexts")
    whole = (
        join_counted(shared, contexts.filter("n > 1").select("anchor", *CONTEXT, "n"), ["anchor", *CONTEXT])
        .select(*doc, F.greatest(F.col("at") - (length - gram), F.lit(0)).alias("low"), F.col("end").alias("high"))
        .filter(F.col("high") - F.col("low") >= length)
    )
    # anchors with different contexts, one of them not settled yet
    mixed = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least")).filter("different > 1 AND least = 1")
    mixed = keep(mixed.select("anchor", "different"), "mixed")
    open_ = keep(join_counted(contexts, mixed, ["anchor"], "different").select("anchor", "one.*", (F.col("different") > MOST_CONTEXTS).alias("frequent")), "open")
    shards = max(1, -(-open_.count() * (2 * length - gram) // SHARD_BYTES))
    # a frequent anchor's contexts have no shard: -1
    shard = F.when(F.col("frequent"), -1).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).cast("long")
    places = keep(open_.select(*doc, F.struct(shard.alias("shard"), "at").alias("place")).groupBy(*doc).agg(F.collect_list("place").alias("places")), "places")
    few = places.count() <= MOST_BROADCAST
    wanted = places.select(*doc)
    picked = src.join(F.broadcast(wanted), doc, "left_semi") if few else src
    # rows that repeat are one source of strings
    segments = keep(_cut_contexts(picked.join(places, doc), length, gram).dropDuplicates(["shard", "id", "digest", "start"]), "segments")
    marks = whole.union(_sort_shards(segments.filter("shard >= 0"), length))
    frequent = segments.filter("shard < 0")
    if not frequent.isEmpty():
        marks = marks.union(_windows(frequent, length))
    marks = keep(marks.groupBy(*doc).agg(F.collect_set(F.struct("low", "high")).alias("marks")), "marks")
    if marks.count() <= MOST_BROADCAST:
        marked = marks.select(*doc)
        touched = src.join(F.broadcast(marked), doc, "left_semi").join(marks, doc)
        clean = src.join(F.broadcast(marked), doc, "left_anti")
    else:
        both = src.join(marks, doc, "left")
        touched, clean = both.filter("marks IS NOT NULL"), both.filter("marks IS NULL")
    none = F.array().cast("array<struct<low:int,high:int>>")
    bare = clean.select("key", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    for path in paths[:-1]:
        drop_path(spark, path)
    return _cut_out(touched).union(bare).withColumnRenamed("key", id_col)
