"""Benchmark decontamination by the q-gram lemma.

If a stretch of text is within e edits of an item of m characters, the two share at least
m - q + 1 - q*e q-grams, and these lie on diagonals (text position less item position) that
differ by e at most. So shared q-grams are counted in diagonal bands of twice that width which
overlap by half; bands that meet the bound are verified by a banded alignment. Items of fewer
than q characters have no q-gram and no edits; they are found where they stand as whole words.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_batches, lean, mix64, only, worker_store

Q = 8
BASE = 0x9E3779B97F4A7C15 | 1


def _fold_codes() -> np.ndarray:
    """Lower case for each code point of the basic plane that has a single one; white space becomes a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            out[i] = 32
        elif len(low := c.lower()) == 1 and low != c:
            out[i] = ord(low)
    return out


def _fold(text: str) -> np.ndarray:
    """Folded code points; as many as the text has."""
    store = worker_store()
    if "fold" not in store:
        store["fold"] = _fold_codes()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 1 << 16, store["fold"][np.minimum(codes, (1 << 16) - 1)], codes)


def _gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q code points from each position on."""
    one = codes.astype(U64) + U64(1)
    h, size = one, 1
    for bit in bin(q)[3:]:  # double, and add one where the bit is set
        h = h[:-size] * U64(pow(BASE, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
        if bit == "1":
            h = h[:-1] * U64(BASE) + one[size:] if len(h) > 1 else h[:0]
            size += 1
    return mix64(h)


def _in_words(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters or digits; those beyond the basic plane count as such."""
    store = worker_store()
    if "in words" not in store:
        store["in words"] = np.array([chr(i).isalnum() for i in range(1 << 16)])
    return np.where(codes < 1 << 16, store["in words"][np.minimum(codes, (1 << 16) - 1)], True)


class Items:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float, q: int = Q):
        self.q = q
        self.ids = [i for i, _ in items]
        self.codes = [_fold(t) for _, t in items]
        # by length, the hashes of items without a q-gram, in order, and their numbers
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, q):
            own = np.array([i for i, c in enumerate(self.codes) if len(c) == size], np.int64)
            if len(own):
                h = np.concatenate([_gram_hashes(self.codes[i], size) for i in own.tolist()])
                order = np.argsort(h, kind="stable")
                self.short[size] = h[order], own[order]
        m = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((m * edit_rate).astype(np.int64), np.maximum((m - q) // q, 0))
        self.bound = m - q + 1 - q * self.edits
        self.width = 2 * (self.edits + 1)
        hashes = [_gram_hashes(c, q) for c in self.codes]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.at = h[order], item[order], at[order]
        bits = max(16, int(len(h) * 16).bit_length())
        self.shift = U64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(h >> self.shift).astype(np.int64)] = True

    def align(self, item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int] | None:
        """Fewest edits between the item and a stretch of the text that starts on diagonals low to low+width-1, and where it ends."""
        m = len(item)
        k = np.arange(width)
        row = np.zeros(width, np.int64)
        big = 1 << 30
        for i in range(1, m + 1):
            j = low + i + k  # one past the text position
            inside = (j >= 1) & (j <= len(text))
            same = np.zeros(width, bool)
            same[inside] = text[j[inside] - 1] == item[i - 1]
            new = np.where(inside, row + ~same, big)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - k) + k
            if row.min() > most:
                return None
        best = int(row.argmin())
        return int(row[best]), low + m + best

    def bands(self, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and band numbers whose counts meet the bound. at: positions in a text; first, n: their runs in the index."""
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        item = self.item[run]
        half = self.edits[item] + 1
        band = (np.repeat(at, n) - self.at[run]) // half
        # half-width steps; a band is a step and the next one
        key = item * (1 << 40) + band + (1 << 39)
        steps, count = np.unique(key, return_counts=True)
        after = np.zeros(len(steps), np.int64)
        follows = steps[1:] == steps[:-1] + 1
        after[:-1][follows] = count[1:][follows]
        items = steps >> 40
        good = count + after >= self.bound[items]
        # a lone second step is also the first of its own band; one before it needs no test of its own
        return items[good], (steps[good] & ((1 << 40) - 1)) - (1 << 39)

    def verify(self, codes: np.ndarray, items: np.ndarray, bands: np.ndarray) -> list[tuple[int, int, int, int]]:
        best: dict[int, tuple[int, int, int]] = {}
        for number, band in zip(items.tolist(), bands.tolist(), strict=True):
            item, most, half = self.codes[number], int(self.edits[number]), int(self.edits[number]) + 1
            if number in best and best[number][0] == 0:
                continue
            low = band * half
            exact = None
            for d in range(max(0, low), low + 2 * half):
                if d + len(item) <= len(codes) and codes[d] == item[0] and np.array_equal(codes[d : d + len(item)], item):
                    exact = d
                    break
            if exact is not None:
                best[number] = (0, exact, exact + len(item))
                continue
            # before the first and after the last shared gram the alignment may leave the band by the edits it has
            found = self.align(item, codes, low - most, 2 * half + 2 * most, most)
            if found is None or found[0] > most:
                continue
            edits, end = found
            # the start: the same alignment from the end backwards
            back = codes[max(0, end - len(item) - most) : end][::-1]
            _, length = self.align(item[::-1], back, -half, 2 * half, len(item)) or (0, len(item))
            if number not in best or edits < best[number][0]:
                best[number] = (edits, max(0, end - min(length, len(back))), end)
        return [(n, s, e, d) for n, (d, s, e) in best.items()]

    def whole_words(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each short item where no letter or digit adjoins its own."""
        out = []
        inside = np.concatenate([[False], _in_words(codes), [False]])
        for size, (hashes, numbers) in self.short.items():
            h = _gram_hashes(codes, size)
            first = np.searchsorted(hashes, h, side="left")
            n = np.searchsorted(hashes, h, side="right") - first
            # a word goes on where letters or digits stand on both sides of an edge
            apart = ~(inside[: len(h)] & inside[1 : len(h) + 1]) & ~(inside[size : len(h) + size] & inside[size + 1 : len(h) + size + 1])
            at = np.flatnonzero((n > 0) & apart)
            number = numbers[np.repeat(first[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(int(n[at].sum()))]
            number, place = np.unique(number, return_index=True)
            out += [(i, p, p + size, 0) for i, p in zip(number.tolist(), np.repeat(at, n[at])[place].tolist(), strict=True) if np.array_equal(codes[p : p + size], self.codes[i])]
        return out

    def search_all(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item number, start, end, edits) of the best stretch for each item that has one within its edits; the grams of all texts are hashed and looked up together."""
        codes = _fold(("\0" * self.q).join(texts))
        h = _gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        first = np.searchsorted(self.hashes, h[at], side="left")
        n = np.searchsorted(self.hashes, h[at], side="right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + self.q)])[:-1]
        cuts = np.searchsorted(at, np.append(starts, np.iinfo(np.int64).max))
        least = int(self.bound[self.bound > 0].min(initial=1 << 40))
        out = []
        for i in range(len(texts)):
            a, b = cuts[i], cuts[i + 1]
            own = codes[starts[i] : starts[i] + sizes[i]]
            found = self.whole_words(own) if self.short else []
            if b - a >= least:  # else fewer positions hit than any item's bound
                found += self.verify(own, *self.bands(at[a:b] - starts[i], first[a:b], n[a:b]))
            out.append(found)
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = 2_000_000):
    """The items in blocks of bounded size. Null and blank items name nothing to search for."""
    items = benchmark.filter(F.col(text_col).rlike(r"\S")).select(F.col(id_col).cast("long"), F.col(text_col)).orderBy(id_col, text_col)
    block, size = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _index(key: str, shared, edit_rate: float) -> Items:
    return only(key, lambda: Items(shared.value, edit_rate))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit_rate: float = 0.1) -> DataFrame:
    """Returns id_col, item_id, start, end (code points), edits: the best stretch for each document and item, where there is one.

    Letters' case and kinds of white space make no difference. Edits are at most edit_rate of an item's
    length, and fewer for items so short that the lemma would bound nothing: below 16 characters there are none, and
    below 8 an item must stand as whole words. Null and blank items, and null and empty texts, have no leaks. Rows
    that repeat an id are searched each for itself. Empty tables: no rows. Other columns are ignored.

    Scale: no shuffle. Items go out in blocks of bounded size, each with one pass over the documents.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, item_id long, start long, end long, edits long"
    out = None
    for block in blocks(benchmark):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            import pyarrow as pa

            items = _index(key, shared, edit_rate)
            for batch in byte_batches(batches, "text"):
                rows = [(i, items.ids[n], s, e, d) for i, found in enumerate(items.search_all(batch.column(1).to_pylist())) for n, s, e, d in found]
                doc, *rest = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *[pa.array(c, pa.int64()) for c in rest]], names=[id_col, "item_id", "start", "end", "edits"])

        found = src.mapInArrow(lean(run), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", edit_rate: float = 0.1) -> DataFrame:
    """docs without the rows that have a leak (see find_leaks); all columns as they are."""
    for block in blocks(benchmark):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, key=key):
            import pyarrow as pa

            items = _index(key, shared, edit_rate)
            for batch in byte_batches(batches, text_col):
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                yield batch.filter(pa.array([not found for found in items.search_all(texts)], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
