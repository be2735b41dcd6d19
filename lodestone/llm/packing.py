"""Packing by harmonic classes.

Class k takes lengths of more than capacity/(k+1) and at most capacity/k, and fills each bin
with exactly k of them. Documents may be cut, so a document gives full sequences first; of
the rest, a piece of exactly floor(capacity/k) is cut off for the largest such size that fits,
until what is left fills its class's share of a bin up to a small part. Every worker fills its
own bins. The few pieces in bins that a worker could not complete are laid end to end and cut
into full sequences, and the last of them into powers of two, which need no padding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizing import encoder, wide, with_end
from .common import byte_batches, lean


def cut_rest(rest: int, capacity: int, slack: float = 1 / 64) -> list[int]:
    """Lengths to cut a rest of less than capacity ids into."""
    out = []
    while rest:
        k = capacity // rest
        share = capacity // k
        if share - rest <= slack * share:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Packer:
    """Fills bins of one worker. Rows are (document, start, length, its ids in all, bytes, sequence, offset)."""

    def __init__(self, capacity: int, worker: int, id_bytes: int):
        self.capacity, self.next, self.id_bytes = capacity, worker << 40, id_bytes
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, key: int | None, ids: bytes) -> None:
        width = self.id_bytes
        start, n = 0, len(ids) // width
        cut = lambda a, size: (key, a, size, n, ids[a * width : (a + size) * width])
        while n - start >= self.capacity:
            self._close([cut(start, self.capacity)])
            start += self.capacity
        for length in cut_rest(n - start, self.capacity):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append(cut(start, length))
            if len(bin_) == k:
                self._close(bin_)
                self.open[k] = []
            start += length

    def finish(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        total, width = sum(p[2] for p in left), self.id_bytes
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(total.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        pieces: list[tuple] = []
        i = used = 0
        for key, start, length, n, ids in left:
            at = 0
            while at < length:
                take = min(length - at, sizes[i] - used)
                pieces.append((key, start + at, take, n, ids[at * width : (at + take) * width]))
                at, used = at + take, used + take
                if used == sizes[i]:
                    self._close(pieces)
                    pieces, used, i = [], 0, i + 1
        self.open = {}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Returns doc_id, start, length, doc_tokens, sequence_id, offset, ids (uint32 bytes): one row per piece.

    A document's ids are those of its whole text and the end id. Null texts are empty. Null ids and rows that
    repeat an id are packed like others, each row for itself. Empty table: no rows. Other columns are ignored.

    Scale: no shuffle; a worker is a partition of the input and keeps fewer than k pieces of each class k, which
    is less than capacity * ln(capacity) pieces in all.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tokens = encoder(tokenizer_path, True)
        packer = Packer(capacity, TaskContext.get().partitionId(), tokens.id_bytes)
        kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

        def emit():
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            columns[4] = [wide(x, tokens.id_bytes).tobytes() for x in columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        for batch in byte_batches(batches, "text"):
            ids, bounds = with_end(*tokens.encode(batch.column(1)), end_id)
            coded, cuts = ids.tobytes(), (bounds * tokens.id_bytes).tolist()
            for key, a, b in zip(batch.column(0).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                packer.add(key, coded[a:b])
            yield emit()
        packer.finish()
        yield emit()

    return src.mapInArrow(lean(run), "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
