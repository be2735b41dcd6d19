"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs of a word are an embedding of the word, the mean embedding of its character n-grams,
and two fixed figures: the word's and its strongest n-gram's log odds of standing in a toxic
training document. Forward and backward GRUs read windows of words; attention pools the
states; a logistic unit scores the window. A document's score is that of its worst window,
over all overlapping windows of its whole text. What stands between spaces is a word, or, if
it is long, several: parts that overlap, so that they have all its n-grams. Everything is
trained here, in numpy.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, byte_batches, lean, mix64, only

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
WORD_DIM, CHAR_DIM = 6, 6
INPUT = WORD_DIM + CHAR_DIM + 2
GRAM_ROWS = 1 << 15
GRAM_SIZES = (3, 4, 5)
#: Letters of a word; longer units are cut into parts of so many.
LONGEST = 24
#: Marks where a part was cut. White space to str.split, so no unit has it.
CUT = "\x1f"
#: N-grams of fewer documents are not learnt; embeddings shrink by this share of the step size.
LEAST_DOCS, DECAY = 8, 1.0
#: Share of words whose own embedding is hidden in training.
HIDE = 0.2
STRIP = ".,;:!?\"'()[]{}<>|*#-_…«»„“”"
LOW = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def plain(unit: str) -> str:
    """A unit between spaces as a word: lower case, without punctuation around it."""
    return unit.lower().strip(STRIP)


def units_of(text: str) -> list[str]:
    """The units between spaces; those of more than LONGEST letters as plain parts, marked by CUT, that share all but one of an n-gram's letters."""
    units = text.split()
    if max(map(len, units), default=0) <= LONGEST:
        return units
    out = []
    step = LONGEST - max(GRAM_SIZES) + 1
    for unit in units:
        whole = unit if len(unit) <= LONGEST else plain(unit)
        if len(whole) <= LONGEST:
            out.append(whole)
            continue
        for a in range(0, len(whole) - LONGEST + step, step):
            out.append((CUT if a else "") + whole[a : a + LONGEST] + CUT)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-gram table for each word, with a mark at its start unless it was cut there: (word number, row), sorted by word."""
    marked = [w.strip(CUT) if w[:1] == CUT else "^" + w.strip(CUT) for w in words]
    width = max(map(len, marked), default=1)
    codes = np.array(marked, dtype=f"<U{width}").view(np.uint32).reshape(len(marked), width).astype(U64)
    word, row = [np.arange(len(words))], [np.zeros(len(words), np.int64)]  # row 0 is every word's, so none is empty
    for n in GRAM_SIZES:
        if n > width:
            break
        h = np.full((len(words), width - n + 1), U64(n))
        for i in range(n):
            h = h * U64(0x9E3779B1) + codes[:, i : width - n + 1 + i] + U64(1)
        rows, at = np.nonzero(codes[:, n - 1 :] > 0)
        word.append(rows)
        row.append((mix64(h[rows, at]) % U64(GRAM_ROWS - 1)).astype(np.int64) + 1)
    word, row = np.concatenate(word), np.concatenate(row)
    order = np.argsort(word, kind="stable")
    return word[order], row[order]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Bounds of the overlapping windows of n words; the last one ends at the end."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


class Gru:
    """One direction, over inputs already multiplied by its weights."""

    def __init__(self, recurrent: np.ndarray):
        self.u = recurrent

    def run(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool):
        """gates: time, row, 3*HIDDEN. Returns states (time, row, HIDDEN), and what backward needs if keep."""
        steps, rows, _ = gates.shape
        h = np.zeros((rows, HIDDEN), LOW)
        states = np.empty((steps, rows, HIDDEN), LOW)
        kept = []
        for t in range(steps):
            a, u = gates[t], h @ self.u
            zr = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            np.clip(zr, -30, 30, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            un = u[:, 2 * HIDDEN :]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * un)
            new = n + z * (h - n)
            if mask is not None:
                new *= mask[t][:, None]
            if keep:
                kept.append((h, z, r, n, un))
            h = states[t] = new
        return states, kept

    def back(self, d_states: np.ndarray, kept: list, mask: np.ndarray | None):
        """Gradients of the gates' inputs and of the recurrent weights."""
        d_u = np.zeros_like(self.u)
        d_gates = np.empty((*d_states.shape[:2], 3 * HIDDEN), LOW)
        d_h = np.zeros(d_states.shape[1:], LOW)
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, n, un = kept[t]
            d = d_states[t] + d_h
            if mask is not None:
                d = d * mask[t][:, None]
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (h - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            inner = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += h.T @ inner
            d_h = d * z + inner @ self.u.T
            d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        return d_gates, d_u


class Network:
    """Weights p: word, gram, w (inputs to the gates of both directions), b, u_f, u_b, a, a_b, a_v, out, out_b."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray):
        self.p, self.vocabulary, self.word_odds, self.gram_odds = p, vocabulary, word_odds, gram_odds

    @classmethod
    def new(cls, vocabulary: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(LOW)
        p = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.05),
            "gram": draw(GRAM_ROWS, CHAR_DIM, scale=0.05),
            "w": draw(INPUT, 6 * HIDDEN, scale=0.3),
            "b": np.zeros(6 * HIDDEN, LOW),
            "u_f": draw(HIDDEN, 3 * HIDDEN, scale=0.2),
            "u_b": draw(HIDDEN, 3 * HIDDEN, scale=0.2),
            "a": draw(2 * HIDDEN, ATTENTION, scale=0.3),
            "a_b": np.zeros(ATTENTION, LOW),
            "a_v": draw(ATTENTION, scale=0.5),
            "out": draw(2 * HIDDEN, scale=0.5),
            "out_b": np.zeros(1, LOW),
        }
        return cls(p, vocabulary, word_odds, gram_odds)

    def inputs(self, words: list[str]):
        """The input of each word, and what it was made of."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        word, row = grams(words)
        first = np.searchsorted(word, np.arange(len(words)))
        count = np.diff(np.append(first, len(word))).astype(LOW)
        chars = np.add.reduceat(self.p["gram"][row], first, axis=0) / count[:, None]
        best = np.maximum.reduceat(self.gram_odds[row], first)
        x = np.concatenate([self.p["word"][ids], chars, self.word_odds[ids][:, None], best[:, None]], axis=1).astype(LOW)
        return x, (ids, word, row, count)

    def gates(self, words: list[str], block: int = 8192) -> np.ndarray:
        parts = [self.inputs(words[a : a + block])[0] @ self.p["w"] + self.p["b"] for a in range(0, len(words), block)]
        return np.concatenate(parts) if parts else np.zeros((0, 6 * HIDDEN), LOW)

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """gates: time, row, 6*HIDDEN, of windows. Returns logits and what backward needs."""
        p, g = self.p, 3 * HIDDEN
        f, kept_f = Gru(p["u_f"]).run(gates[:, :, :g], mask, keep)
        back_mask = None if mask is None else mask[::-1]
        b, kept_b = Gru(p["u_b"]).run(gates[::-1, :, g:], back_mask, keep)
        states = np.concatenate([f, b[::-1]], axis=2)
        e = np.tanh(states @ p["a"] + p["a_b"])
        s = e @ p["a_v"]
        if mask is not None:
            s = np.where(mask > 0, s, LOW(-1e9))
        s = np.exp(s - s.max(axis=0))
        if mask is not None:
            s = s * mask
        weight = s / np.maximum(s.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ p["out"] + p["out_b"], (states, e, weight, pooled, kept_f, kept_b, mask, back_mask)

    def backward(self, d_logit: np.ndarray, kept):
        """Gradients of the gates' inputs and of all weights behind them."""
        p, g = self.p, {}
        states, e, weight, pooled, kept_f, kept_b, mask, back_mask = kept
        g["out"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_s = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["a_v"] = np.einsum("tb,tba->a", d_s, e)
        d_e = d_s[:, :, None] * p["a_v"] * (1 - e * e)
        g["a"], g["a_b"] = np.einsum("tbh,tba->ha", states, d_e), d_e.sum(axis=(0, 1))
        d_states = d_states + d_e @ p["a"].T
        d_f, g["u_f"] = Gru(p["u_f"]).back(d_states[:, :, :HIDDEN], kept_f, mask)
        d_b, g["u_b"] = Gru(p["u_b"]).back(d_states[::-1, :, HIDDEN:], kept_b, back_mask)
        return np.concatenate([d_f, d_b[::-1]], axis=2), g


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds by document counts: the end nearer to zero of their 95 % interval, within -4 and 4; zero for what few documents have."""
    raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    sure = np.maximum(np.abs(raw) - 1.96 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), 0) * np.sign(raw)
    return np.where(toxic + clean >= LEAST_DOCS, np.clip(sure, -4, 4), 0).astype(LOW)


def fit(texts: list[str], toxic: list[int], rounds: int = 10, most_words: int = 20_000, seed: int = 7) -> Network | None:
    """Multiple-instance training: each round takes every document's worst windows under the network so far.

    None if either class is missing.
    """
    if not 0 < sum(toxic) < len(toxic):
        return None
    rng = np.random.default_rng(seed)
    y = np.array(toxic)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in map(plain, units_of(t))], np.int64) for t in texts]
    words = list(number)
    in_docs = {k: np.zeros(len(words)) for k in (0, 1)}
    gram_docs = {1: np.zeros(GRAM_ROWS), 0: np.zeros(GRAM_ROWS)}
    # rows of the n-gram table of all words, end to end, and where each word's begin
    gram_parts, gram_counts = [], []
    for a in range(0, len(words), 8192):
        word_of, row = grams(words[a : a + 8192])
        gram_parts.append(row.astype(np.int32))
        gram_counts.append(np.bincount(word_of))
    gram_row = np.concatenate(gram_parts) if gram_parts else np.zeros(0, np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate(gram_counts) if gram_counts else np.zeros(0, np.int64))])
    for d, label in zip(docs, toxic, strict=True):
        own = np.unique(d)
        in_docs[label][own] += 1
        rows = np.concatenate([gram_row[first[w] : first[w + 1]] for w in own.tolist()]) if len(own) else np.zeros(0, np.int64)
        gram_docs[label][np.unique(rows)] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    odds, both = _odds(in_docs[1], in_docs[0], n1, n0), in_docs[1] + in_docs[0]
    known = np.flatnonzero(both >= LEAST_DOCS).tolist()
    common = sorted(known, key=lambda w: (-abs(odds[w]), -both[w], words[w]))[:most_words]
    vocabulary = {words[w]: i + 1 for i, w in enumerate(common)}
    word_odds = np.concatenate([np.zeros(1, LOW), odds[common]])
    both = gram_docs[1] + gram_docs[0]
    gram_odds = _odds(gram_docs[1], gram_docs[0], n1, n0)
    net = Network.new(vocabulary, word_odds, gram_odds, seed)
    # n-grams of few documents would only be learnt by heart
    rare = both < LEAST_DOCS
    net.p["gram"][rare] = 0

    spans = [(i, a, b) for i, d in enumerate(docs) for a, b in windows_of(len(d))]
    owner = np.array([s[0] for s in spans])
    index = np.full((len(spans), WINDOW), -1, np.int32)
    for k, (i, a, b) in enumerate(spans):
        index[k, : b - a] = docs[i][a:b]
    del gram_parts
    strong = np.zeros(len(words) + 1, LOW)
    for a in range(0, len(words), 8192):
        x, _ = net.inputs(words[a : a + 8192])
        strong[a : a + len(x)] = x[:, -2] + x[:, -1]
    scores = strong[index].max(axis=1) + 0.01 * strong[index].sum(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for round_ in range(rounds):
        order = np.lexsort((-scores, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[(place == 0) | ((place < 3) & (y[owner[order]] == 0))]
        some = rng.permutation(len(spans))[: len(chosen) // 2]
        chosen = np.concatenate([chosen, some[y[owner[some]] == 0]])
        rng.shuffle(chosen)
        rate = 0.01 * (1 - round_ / rounds) + 0.001
        balance = max(1.0, 0.5 * (y[owner[chosen]] == 0).sum() / max(1, (y[owner[chosen]] == 1).sum()))
        for a in range(0, len(chosen), 128):
            part = chosen[a : a + 128]
            ids, where = np.unique(index[part], return_inverse=True)
            where = where.reshape(len(part), WINDOW).T
            pad = int(ids[0] == -1)
            x, (word_ids, word, row, count) = net.inputs([words[i] for i in ids[pad:]] or [""])
            # some words are hidden, so that their letters have to do
            hidden = rng.random(len(x)) < HIDE
            x[hidden, :WORD_DIM] = net.p["word"][0]
            x[hidden, -2] = 0
            word_ids = np.where(hidden, 0, word_ids)
            gates_of = x @ net.p["w"] + net.p["b"]
            mask = (index[part].T >= 0).astype(LOW)
            gates = gates_of[np.maximum(where - pad, 0)]
            target = y[owner[part]].astype(LOW)
            logit, kept = net.forward(gates, mask, keep=True)
            weight = np.where(target > 0, balance, 1.0) / len(part)
            d_gates, grad = net.backward(((sigmoid(logit) - target) * weight).astype(LOW), kept)
            d_gates = (d_gates * mask[:, :, None]).reshape(-1, 6 * HIDDEN)
            d_word = np.zeros_like(gates_of)
            np.add.at(d_word, np.maximum(where - pad, 0).ravel(), d_gates)
            grad["w"], grad["b"] = x.T @ d_word, d_word.sum(axis=0)
            d_x = d_word @ net.p["w"].T
            grad["word"] = np.zeros_like(net.p["word"])
            np.add.at(grad["word"], word_ids, d_x[:, :WORD_DIM])
            grad["gram"] = np.zeros_like(net.p["gram"])
            np.add.at(grad["gram"], row, (d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / count[:, None])[word])
            grad["gram"][rare] = 0
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(LOW)
                if k in ("word", "gram"):
                    net.p[k] *= LOW(1 - DECAY * rate)
        table = np.concatenate([net.gates(words), np.zeros((1, 6 * HIDDEN), LOW)])
        scores = np.concatenate([net.forward(table[index[a : a + 1024].T], (index[a : a + 1024].T >= 0).astype(LOW))[0] for a in range(0, len(index), 1024)])
    return net


class Scorer:
    """Scores texts, keeping the gates' inputs of what stands between spaces."""

    def __init__(self, net: Network, most: int = 90_000):
        self.net, self.most = net, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((self.most, 6 * HIDDEN), LOW)
        self.used = 1  # row 0 is padding

    def _learn(self, units: list[str]) -> None:
        for a in range(0, len(units), 4096):
            part = units[a : a + 4096]
            need = self.used + len(part)
            if need > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((need - len(self.table) + 4096, 6 * HIDDEN), LOW)])
            self.table[self.used : need] = self.net.gates([plain(u) for u in part])
            self.index.update(zip(part, range(self.used, need), strict=True))
            self.used = need

    def score(self, texts: list[str]) -> np.ndarray:
        pieces = [units_of(t) for t in texts]
        wanted = set().union(*pieces) if pieces else set()
        new = [u for u in wanted if u not in self.index]
        if self.used + len(new) > self.most:
            self._clear()
            new = list(wanted)
        self._learn(new)
        get = self.index.__getitem__
        sizes = np.array([len(p) for p in pieces])
        flat = np.array([i for p in pieces for i in map(get, p)] + [0] * WINDOW, np.int32)
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        # window numbers of all documents at once
        n = np.where(sizes <= WINDOW, 1, -(-(sizes - WINDOW) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(sizes)), n)
        at = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(n)])[:-1][owner]
        begin = np.minimum(at * STRIDE, np.maximum(sizes[owner] - WINDOW, 0))
        full = sizes[owner] >= WINDOW
        out = np.full(len(sizes), -np.inf)
        steps = np.arange(WINDOW)[:, None]
        for is_full in (True, False):
            which = np.flatnonzero(full == is_full)
            for a in range(0, len(which), 1024):
                k = which[a : a + 1024]
                rows = flat[(starts[owner[k]] + begin[k])[None, :] + steps]
                mask = None
                if not is_full:
                    mask = (steps < sizes[owner[k]]).astype(LOW)
                    rows = np.where(mask > 0, rows, 0)
                logit, _ = self.net.forward(self.table[rows], mask)
                np.maximum.at(out, owner[k], logit)
        return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_out: int = 1, most_toxic: int = 1000, most_clean: int = 2500, most_bytes: int = 30_000_000) -> Network | None:
    """Fits on most_toxic toxic and most_clean other whole documents at most (those first by a hash of their id), of folds that aren't held out.

    Documents that start beyond most_bytes of text, in that order and by class, teach nothing, nor do null texts, ids and labels; an
    id with several labels is toxic if one says so, and several texts of it all teach. Without both classes: None.
    """
    fold = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds
    known = labels.filter((fold != held_out) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    labelled: dict = {}
    for label, most in ((1, most_toxic), (0, most_clean)):
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        labelled |= {r["id"]: label for r in some.collect()}
    if len(set(labelled.values())) < 2:
        return None
    texts = docs.filter(F.col(id_col).isin(list(labelled)) & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("label", F.col("id").isin([i for i, y in labelled.items() if y]))
    texts = texts.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(by_hash), F.lit(0))).filter(F.col("before") < most_bytes)
    texts = texts.select("id", "text").collect()
    texts.sort(key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in texts], [labelled[r["id"]] for r in texts])


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Returns id_col and score, or, given a struct column row_col that holds the text, row_col and score: one row per document.

    Null and empty texts have one window without words, whose score the network gives. Without a network (a class
    without examples) the score is 0. Rows that repeat, and null ids, are scored each for itself. Empty table: no rows.
    Other columns are ignored.

    Scale: no shuffle; the network is of fixed size and goes to the executors once; workers keep the inputs of a
    bounded number of words.
    """
    src = docs.select(row_col) if row_col else docs.select(id_col, text_col)
    kept = src.columns[0]
    if net is None:
        return src.select(kept, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.vocabulary, net.word_odds, net.gram_odds))
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        scorer = only(key, lambda: Scorer(Network(*shared.value)))
        pairs = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(text_col) if row_col else b.column(1)], names=["kept", "_text"]) for b in batches)
        for batch in byte_batches(pairs, "_text", 1_000_000):
            scores = scorer.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[kept, "score"])

    return src.mapInArrow(lean(run), f"`{kept}` {src.schema[kept].dataType.simpleString()}, score double")
