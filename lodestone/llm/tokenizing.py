"""Token ids of whole texts, as the tokenizers library gives them, with the ids of words kept between texts."""

from __future__ import annotations

import os

import numpy as np

from .common import U64, mix64, only, text_bytes

#: White space other than the plain space and the line feed, that Python or Unicode knows.
RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: How a leading space shows in byte-level tokens, and what parts words where spaces do not show.
SPACE_MARK, BAR = "Ġ", "|"
#: Units of more bytes are not kept in the table.
LONGEST = 32
SLOTS = 1 << 20
MOST_IDS = 4_000_000
#: Kinds of units: a word without and with a space before it, white space before a word, white space at a text's end.
BARE, LED, BETWEEN, LAST = range(4)
_SEPARATES = np.isin(np.arange(256), [10, 32])
_RARE_FIRST = np.isin(np.arange(256), sorted({c.encode()[0] for c in RARE}))


class Encoder:
    """ids and bounds of the texts of a column, exactly those of the library's encode(text, add_special_tokens=False).

    A text is cut into units: words, and white space between them. Both kinds of pre-tokenizer cut before a single
    space that a word follows, and on both sides of other white space, so a unit's ids depend on the unit and its
    kind alone. Units are looked up in a table by their own bytes (up to LONGEST; longer ones are encoded each time),
    many at once; the library encodes those that are missing. A text that has other white space than spaces and line
    feeds, or the text of an added token, is encoded as a whole.

    drops_space: the tokenizer gives white space no ids (it must then not depend on it either).
    """

    def __init__(self, path: str, drops_space: bool, slots: int = SLOTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.id_bytes = self.kind.itemsize
        self.drops_space = drops_space
        self.added = [(t.content.encode(), t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mask = U64(slots - 1)
        self.words = [np.zeros(slots, U64) for _ in range(LONGEST // 8)]
        self.meta = np.zeros(slots, np.uint32)
        self.start, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.filled = 0
        self.begins = np.zeros(size, bool)
        if drops_space:
            (self.bar,) = self.tokenizer.encode(BAR, add_special_tokens=False).ids
        else:
            (self.bar,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(SPACE_MARK)]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    # ------------------------------------------------------------- new units

    def _lines(self, words: list[str], led: bool, size: int = 2048) -> list[np.ndarray]:
        """Ids of words, encoded in long lines that come apart at the ids of what stands between."""
        lines = [words[a : a + size] for a in range(0, len(words), size)]
        if self.drops_space:
            texts = [f"{BAR} " + f" {BAR} ".join(line) for line in lines]
        else:
            texts = [" " + " ".join(line) if led else "\n" + "\n".join(line) for line in lines]
        out: list[np.ndarray] = []
        for line, ids in zip(lines, self._encode(texts), strict=True):
            by_space = led and not self.drops_space
            cuts = np.flatnonzero(self.begins[ids] if by_space else ids == self.bar)
            if len(cuts) == len(line):
                ends = np.append(cuts[1:], len(ids))
                cuts = cuts if by_space else cuts + 1
                out += [ids[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            else:
                out += self._encode([" " + w for w in line] if by_space else line)
        return out

    def _spaces(self, runs: list[str], kind: int) -> list[np.ndarray]:
        """Ids of white space: those that the library adds for it beside a word."""
        out = []
        for run in runs:
            if kind == LAST:
                (whole,), (word,) = self._encode(["x" + run]), self._encode(["x"])
                out.append(whole[len(word) :])
            else:
                # the last space belongs to the word
                (whole,), (word,) = self._encode([run + "x"]), self._encode([" x" if run[-1] == " " else "x"])
                out.append(whole[: len(whole) - len(word)])
        return out

    def _learn(self, units: list[tuple[int, bytes]]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(units)
        for kind in (BARE, LED, BETWEEN, LAST):
            own = [i for i, u in enumerate(units) if u[0] == kind]
            texts = [units[i][1].decode() for i in own]
            if kind in (BETWEEN, LAST):
                found = self._spaces(texts, kind)
            elif self.drops_space:
                # a word that has a bar cannot stand in a line
                alone = [i for i, t in enumerate(texts) if BAR in t]
                found = dict(zip(alone, self._encode([texts[i] for i in alone]), strict=True)) if alone else {}
                rest = [i for i in range(len(texts)) if i not in found]
                found |= dict(zip(rest, self._lines([texts[i] for i in rest], False), strict=True))
                found = [found[i] for i in range(len(texts))]
            else:
                found = self._lines(texts, kind == LED)
            for i, ids in zip(own, found, strict=True):
                out[i] = ids
        return out

    def _keep(self, ids: list[np.ndarray]) -> np.ndarray:
        """Adds ids to the pool; where each begins."""
        sizes = np.array([len(x) for x in ids], np.int64)
        need = self.used + int(sizes.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need - len(self.pool), len(self.pool)), self.kind)])
        if len(ids):
            self.pool[self.used : need] = np.concatenate(ids)
        starts = self.used + np.cumsum(sizes) - sizes
        self.used = need
        return starts

    # ---------------------------------------------------------------- texts

    def _units(self, data: np.ndarray, offsets: np.ndarray, live: np.ndarray):
        """Start, end and kind of the units of the texts that are live, in order."""
        n = len(data)
        separates = _SEPARATES[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = edge[:-1].copy()
        first[1:] |= separates[1:] != separates[:-1]
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        blank = separates[start]
        if self.drops_space:
            kind, wanted = np.zeros(len(start), np.uint32), ~blank
        else:
            last = edge[end]
            led = ~blank & ~edge[start] & (data[np.maximum(start, 1) - 1] == 32)
            kind = np.where(blank, np.where(last, LAST, BETWEEN), np.where(led, LED, BARE)).astype(np.uint32)
            # a space that a word follows is the word's
            wanted = ~(blank & ~last & (end - start == 1) & (data[start] == 32))
        if not live.all():
            wanted &= live[np.searchsorted(offsets, start, side="right") - 1]
        return start[wanted], end[wanted], kind[wanted]

    def _look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray):
        """Where in the pool each unit's ids begin, and how many they are."""
        size = end - start
        padded = np.zeros(len(data) + LONGEST, np.uint8)
        padded[: len(data)] = data
        words = padded.astype(np.uint64)
        for shift in (1, 2, 4):  # the eight bytes from each place on
            words[:-shift] |= words[shift:] << U64(8 * shift)
        full = (U64(1) << (np.arange(8, dtype=U64) * U64(8))) - U64(1)
        full = np.append(full, U64(0xFFFFFFFFFFFFFFFF))  # by how many of the eight bytes count
        meta = (size.astype(np.uint32) << np.uint32(2)) | kind
        keys = [words[start] & full[np.minimum(size, 8)]]
        h = keys[0] ^ (meta.astype(U64) * U64(0x9E3779B97F4A7C15))
        more = []
        for i in range(1, LONGEST // 8):
            # few units are long: the rest of their bytes is kept apart
            who = np.flatnonzero(size > 8 * i)
            part = words[start[who] + 8 * i] & full[np.minimum(size[who] - 8 * i, 8)]
            more.append((who, part))
            h[who] = mix64(h[who] + U64(i)) ^ part
        del words
        h = mix64(h)
        one, two = (h & self.mask).astype(np.int64), ((h >> U64(32)) & self.mask).astype(np.int64)

        def same(slot: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = (self.words[0][slot] == keys[0][of]) & (self.meta[slot] == meta[of])
            if len(of) == len(size):
                for i, (who, part) in enumerate(more):
                    out[who] &= self.words[i + 1][slot[who]] == part
            else:
                place = np.full(len(size), -1, np.int64)
                place[of] = np.arange(len(of))
                for i, (who, part) in enumerate(more):
                    at = place[who]
                    there = at >= 0
                    out[at[there]] &= self.words[i + 1][slot[at[there]]] == part[there]
            return out & (size[of] <= LONGEST)

        everything = np.arange(len(size))
        slot = one.copy()
        missing = np.flatnonzero(~same(one, everything))
        if len(missing):
            second = same(two[missing], missing)
            slot[missing[second]] = two[missing[second]]
            missing = missing[~second]
        begin, count = self.start[slot].astype(np.int64), self.count[slot].astype(np.int64)
        if len(missing):
            buffer = data.tobytes()
            number: dict[tuple[int, bytes], int] = {}
            which = np.array([number.setdefault((k, buffer[a:b]), len(number)) for a, b, k in zip(start[missing].tolist(), end[missing].tolist(), kind[missing].tolist(), strict=True)], np.int64)
            ids = self._learn(list(number))
            starts = self._keep(ids)
            counts = np.array([len(x) for x in ids], np.int64)
            begin[missing], count[missing] = starts[which], counts[which]
            _, example = np.unique(which, return_index=True)
            example = example[size[missing[example]] <= LONGEST]
            unit, new = missing[example], which[example]
            # what is in the table stays, as the frequent units come first
            free = np.where(self.meta[one[unit]] == 0, one[unit], two[unit])
            free, chosen = np.unique(np.where(self.meta[free] == 0, free, -1), return_index=True)
            free, chosen = (free[1:], chosen[1:]) if len(free) and free[0] < 0 else (free, chosen)
            self.filled += len(free)
            unit, new = unit[chosen], new[chosen]
            self.meta[free], self.words[0][free] = meta[unit], keys[0][unit]
            for i, (who, part) in enumerate(more):
                rest = np.zeros(len(size), U64)
                rest[who] = part
                self.words[i + 1][free] = rest[unit]
            self.start[free], self.count[free] = starts[new], counts[new]
        return begin, count

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are to be encoded as they are."""
        out = np.zeros(len(offsets) - 1, bool)
        places: list[int] = []
        buffer = data.tobytes()
        for content, normalized in self.added:
            text, content = (buffer.lower(), content.lower()) if normalized else (buffer, content)
            at = text.find(content)
            while at >= 0:
                places.append(at)
                at = text.find(content, at + 1)
        if not self.drops_space:
            for at in np.flatnonzero(_RARE_FIRST[data]).tolist():
                byte = buffer[at]
                if byte < 128 or buffer[at : at + (2 if byte < 0xE0 else 3)].decode("utf-8", "replace") in RARE:
                    places.append(at)
        if places:
            out[np.searchsorted(offsets, places, side="right") - 1] = True
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of an Arrow string column, end to end, and the n+1 bounds of the texts. Nulls are empty."""
        data, offsets = text_bytes(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n + 1, np.int64)
        if self.used > MOST_IDS or self.filled > 0.7 * len(self.meta):
            self.meta[:] = 0
            self.used = self.filled = 0
        whole = self._whole(data, offsets)
        start, end, kind = self._units(data, offsets, ~whole)
        begin, count = self._look_up(data, start, end, kind)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(start, offsets)]
        if whole.any():
            rows = np.flatnonzero(whole).tolist()
            found = dict(zip(rows, self._encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows]), strict=True))
            parts = [found[i] if i in found else ids[bounds[i] : bounds[i + 1]] for i in range(n)]
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an id after each text."""
    return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))


def encoder(path: str, drops_space: bool) -> Encoder:
    """This process's encoder for the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return only(("encoder", path, drops_space), lambda: Encoder(path, drops_space))


def wide(ids: bytes, id_bytes: int) -> np.ndarray:
    return np.frombuffer(ids, dtype=f"<u{id_bytes}").astype("<u4")
