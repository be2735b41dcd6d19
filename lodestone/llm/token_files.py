"""Token-id files with Elias-Fano boundaries.

A file holds the ids of consecutive documents end to end, and two monotone sequences in
Elias-Fano form: where each document ends and the documents' own ids. Each value is split
into low bits, stored as they are, and a high part, stored as ones in a unary bit vector;
the position of the i-th one (select) gives the value back. A sample of every 64th one's
position makes select constant in time. No 64-bit table is stored.

Layout, little-endian:
    8 bytes  magic LSEF0002
    8 x 4    documents, ids, width of an id in bytes, null document ids (first in the file)
    sequence of ends, sequence of document ids, then the ids
    sequence: int64 base, uint64 largest, uint32 count, uint8 low bits, 3 bytes zero,
              uint64 bytes of low bits, low bits, uint64 bytes of high bits, high bits,
              uint32 samples, samples (uint32 each)
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokenizing import encoder, wide, with_end
from .common import byte_batches, lean

MAGIC = b"LSEF0002"
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, base: int, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.base, self.count, self.low_bits = base, count, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(values[0])
        v = values.astype(np.uint64) - np.uint64(base % (1 << 64))
        largest = int(v[-1])
        low_bits = max(0, (largest // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(base, n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        start, stop = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        at = int(self.samples[i // SAMPLE])
        skip = i % SAMPLE
        byte = at // 8
        if skip:
            ones = 0
            step = 64
            while True:
                bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + step], bitorder="little"))
                bits = bits[bits + 8 * byte >= at]
                if ones + len(bits) > skip:
                    at = int(bits[skip - ones]) + 8 * byte
                    break
                ones += len(bits)
                byte += step
        return self.base + ((at - i) << self.low_bits) + int(self._lows(i, i + 1)[0])

    def select_run(self, first: int, last: int) -> np.ndarray:
        """The values first to last-1: one select each end of the run, and the bits between."""
        if first >= last:
            return np.zeros(0, np.int64)
        start, stop = int(self.samples[first // SAMPLE]), len(self.high) * 8
        if -(-last // SAMPLE) < len(self.samples):
            stop = int(self.samples[-(-last // SAMPLE)])
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")) + 8 * (start // 8)
        ones = ones[np.searchsorted(ones, start) :][first % SAMPLE :][: last - first]
        v = ((ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) + self._lows(first, last)
        return (v + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def to_bytes(self) -> bytes:
        low, high, samples = self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()
        head = struct.pack("<qIBxxx", self.base, self.count, self.low_bits)
        return b"".join([head, struct.pack("<Q", len(low)), low, struct.pack("<Q", len(high)), high, struct.pack("<I", len(self.samples)), samples])

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        base, count, low_bits = struct.unpack_from("<qIBxxx", data, at)
        at += 16
        parts = []
        for _ in range(2):
            (size,) = struct.unpack_from("<Q", data, at)
            parts.append(np.frombuffer(data, np.uint8, size, at + 8))
            at += 8 + size
        (n,) = struct.unpack_from("<I", data, at)
        return cls(base, count, low_bits, *parts, np.frombuffer(data, "<u4", n, at + 4)), at + 4 + 4 * n


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, ids: list[np.ndarray]) -> bytes:
    """One file. Documents come in ascending order of their ids, null ids first; sizes says how many token ids each has."""
    nulls = sum(x is None for x in doc_ids)
    ends = np.cumsum(sizes, dtype=np.int64)
    width = ids[0].dtype.itemsize if ids else 2
    head = struct.pack("<QQQQ", len(doc_ids), int(ends[-1]) if len(ends) else 0, width, nulls)
    return b"".join([MAGIC, head, EliasFano.of(ends).to_bytes(), EliasFano.of(np.array(doc_ids[nulls:], np.int64)).to_bytes(), *[x.tobytes() for x in ids]])


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token-id file")
        self.documents, self.total, self.id_bytes, self.nulls = struct.unpack_from("<QQQQ", view, 8)
        self.ends, at = EliasFano.read(view, 40)
        self.keys, at = EliasFano.read(view, at)
        self.ids = view[at : at + self.total * self.id_bytes]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return wide(self.ids[a * self.id_bytes : b * self.id_bytes], self.id_bytes)

    def blocks(self, size: int = 1024):
        """Runs of documents: their ids, starts and ends, as select gives them. No table of the whole file is made."""
        before = 0
        for first in range(0, self.documents, size):
            last = min(first + size, self.documents)
            nulls = max(0, min(last, self.nulls) - first)
            keys = [None] * nulls + self.keys.select_run(max(first - self.nulls, 0), max(last - self.nulls, 0)).tolist()
            ends = self.ends.select_run(first, last)
            yield keys, np.concatenate([[before], ends[:-1]]), ends
            before = int(ends[-1])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_bytes: int = 4_000_000, partitions: int | None = None) -> None:
    """Encodes every whole text and writes files of about file_bytes under path, in ascending order of ids.

    Null texts are empty and have the end id alone; null ids come first; rows of one id follow each other by
    text. Empty table: no files. Other columns are ignored. A manifest (file, documents, ids) is written as
    Parquet beside the files.

    Scale: texts are dealt once by ranges of ids; each task streams its range into files and holds one file at a
    time. A file gets its final name when it is whole, and its name follows from range and number, so a task that
    runs again replaces what it wrote.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = src.repartitionByRange(partitions, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    folder = f"{path}/files"

    def encode(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = encoder(tokenizer_path, False)
        store, root = fs.FileSystem.from_uri(folder)
        keys, sizes, ids, made = [], [], [], []

        def flush():
            name = f"ids-{part:06d}-{len(made):06d}.lsef"
            store.create_dir(root, recursive=True)
            draft = f"{root}/.{uuid.uuid4().hex}"
            each = np.concatenate(sizes)
            with store.open_output_stream(draft) as out:
                out.write(pack_file(keys, each, ids))
            store.move(draft, f"{root}/{name}")
            made.append((part, len(made), name, len(keys), int(each.sum())))

        for batch in byte_batches(batches, "text"):
            coded, bounds = with_end(*tokens.encode(batch.column(1)), end_id)
            keys += batch.column(0).to_pylist()
            sizes.append(np.diff(bounds))
            ids.append(coded)
            if sum(x.nbytes for x in ids) >= file_bytes:
                flush()
                keys, sizes, ids = [], [], []
        if keys:
            flush()
        names = ["part", "seq", "file", "documents", "ids"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)

    ranged.mapInArrow(lean(encode), "part int, seq int, file string, documents long, ids long").write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files with start: how many ids all files before have. Ranges are summed first, then files within a range."""
    files = spark.read.parquet(f"{path}/manifest")
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    return files.withColumn("inside", inside).join(before, "part").select("part", "seq", "file", "documents", "ids", (F.col("before") + F.col("inside")).alias("start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and with_ids the ids as uint32 bytes."""
    known = manifest(spark, path)
    schema = "file string, doc_id long, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    if known.isEmpty():
        return spark.createDataFrame([], schema).select("doc_id", F.col("inside").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = TokenFile(content.as_buffer())
                for keys, starts, ends in file.blocks():
                    parts = [wide(file.ids[a * file.id_bytes : b * file.id_bytes], file.id_bytes).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [
                        pa.array([name.rpartition("/")[2]] * len(keys), pa.string()),
                        pa.array(keys, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    ]
                    names = ["file", "doc_id", "inside", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(parts, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lsef").load(f"{path}/files").select("path", "content")
    rows = files.mapInArrow(lean(decode), schema)
    return rows.join(known.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
