"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Piece probabilities are fitted by expectation
maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, byte_batches, lean, mix64, only

START = "▁"
LONGEST_WORD = 40
FLOOR = 1e-7
BASE = U64(0x100000001B3)
#: Runs that hold all letters, and some signs that are numbers without being digits.
LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters, as str.isalpha knows them."""
    runs = LETTERS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def vocabulary_pieces(path: str) -> list[str]:
    """The lower-cased distinct pieces of a sentencepiece model that are letters, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
    return sorted(p for p in pieces if p.lstrip(START).isalpha())


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words, one row each, zero-padded. Words have LONGEST_WORD letters at most."""
    width = max(map(len, words))
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(U64)


class Segmenter:
    """The vocabulary's pieces as a hash index."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        codes = _codes(pieces)
        h = np.zeros(len(pieces), U64)
        for i in range(codes.shape[1]):
            h = np.where(codes[:, i] > 0, h * BASE + codes[:, i] + U64(1), h)
        h = mix64(h)
        order = np.argsort(h)
        self.hashes, self.order = h[order], order
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> U64(44)).astype(np.int64)] = True

    def lattice(self, words: list[str]):
        """For each end position and length: the rows that match a piece there, and the piece."""
        codes = _codes(words)
        h = np.zeros_like(codes)
        out = {}
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            # the piece of this length that ends at i is the one a letter shorter that ends at i-1, and one more letter
            before = np.zeros_like(h)
            before[:, 1:] = h[:, :-1]
            h = before * BASE + codes + U64(1)
            at = mix64(h[:, length - 1 :])
            rows, ends = np.nonzero(self.seen[(at >> U64(44)).astype(np.int64)] & (codes[:, length - 1 :] > 0))
            keys = at[rows, ends]
            slot = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            hit = self.hashes[slot] == keys
            rows, ends, piece = rows[hit], ends[hit] + length - 1, self.order[slot[hit]]
            by_end = np.argsort(ends, kind="stable")
            rows, ends, piece = rows[by_end], ends[by_end], piece[by_end]
            cuts = np.searchsorted(ends, np.arange(codes.shape[1] + 1))
            for i in range(codes.shape[1]):
                if cuts[i] < cuts[i + 1]:
                    out[i + 1, length] = rows[cuts[i] : cuts[i + 1]], piece[cuts[i] : cuts[i + 1]]
        lengths = (codes > 0).sum(axis=1)
        return lengths, out

    def forward(self, words: list[str], prob: np.ndarray):
        """Forward sums: alpha[i] is the probability of the first i letters, per word and language. A letter on its own has FLOOR besides."""
        lengths, lattice = self.lattice(words)
        width = int(lengths.max())
        alpha = np.zeros((width + 1, len(words), prob.shape[1]))
        alpha[0] = 1.0
        for i in range(1, width + 1):
            alpha[i] = alpha[i - 1] * FLOOR
            for length in range(1, min(self.longest, i) + 1):
                if (found := lattice.get((i, length))) is not None:
                    rows, piece = found
                    alpha[i, rows] += alpha[i - length, rows] * prob[piece]
        return alpha, lengths, lattice

    def log_probs(self, words: list[str], prob: np.ndarray, block: int = 8192) -> np.ndarray:
        """Log probability of each word, a column per language."""
        out = np.zeros((len(words), prob.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), block):
            part = order[a : a + block]
            alpha, lengths, _ = self.forward([words[i] for i in part], prob)
            out[part] = np.log(alpha[lengths, np.arange(len(part))])
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray, block: int = 8192) -> np.ndarray:
        """Expected uses of each piece, by forward and backward sums. counts: one column per language."""
        total = np.zeros_like(prob)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), block):
            part = order[a : a + block]
            alpha, lengths, lattice = self.forward([words[i] for i in part], prob)
            width, n = int(lengths.max()), len(part)
            beta = np.zeros_like(alpha)
            beta[lengths, np.arange(n)] = 1.0
            scale = counts[part] / alpha[lengths, np.arange(n)]
            for i in range(width, 0, -1):
                beta[i - 1] += beta[i] * FLOOR
                for length in range(1, min(self.longest, i) + 1):
                    if (found := lattice.get((i, length))) is not None:
                        rows, piece = found
                        through = beta[i, rows] * prob[piece]
                        np.add.at(total, piece, alpha[i - length, rows] * through * scale[rows])
                        beta[i - length, rows] += through
        return total


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, each with the mark of a start; long ones in parts."""
    out = []
    for word in letter_runs(text.lower()):
        word = START + word
        out += [word[i : i + LONGEST_WORD] for i in range(0, len(word), LONGEST_WORD)]
    return out


def fit(samples: list[tuple[str, str]], priors: dict[str, int], pieces: list[str], rounds: int = 4, smoothing: float = 0.02) -> dict | None:
    """samples: (language, text). priors: how many labelled documents each language has. None where nothing can be learnt."""
    langs = sorted({lang for lang, _ in samples})
    tally: dict[str, np.ndarray] = {}
    for lang, text in samples:
        for word in words_of(text):
            tally.setdefault(word, np.zeros(len(langs)))[langs.index(lang)] += 1
    if not tally:
        return None
    words = list(tally)
    counts = np.array([tally[w] for w in words])
    segmenter = Segmenter(pieces)
    prob = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        used = segmenter.expected(words, counts, prob) + smoothing
        prob = used / used.sum(axis=0)
    prior = np.array([priors.get(lang, 0) + 1.0 for lang in langs])
    return {"langs": langs, "pieces": pieces, "prob": prob.astype(np.float32), "prior": np.log(prior / prior.sum())}


def train(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held_out: int = 0, docs_per_language: int = 150, bytes_per_language: int = 4_000_000) -> dict | None:
    """Fits on whole documents of each language, of folds that aren't held out: those first by a hash of their id, docs_per_language at most, and none that starts beyond bytes_per_language.

    Rows with a null text or language teach nothing; an id that repeats is one document for the choice. Empty table, or
    none that teaches: None. Every language is learnt; the driver holds its documents and a row of the model for each.
    """
    fold = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds
    known = docs.filter((fold != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    priors = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not priors:
        return None
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # at most docs_per_language ids a language, each task keeping so many
    first = known.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= docs_per_language)
    chosen = [r["id"] for r in first.select("id").distinct().collect()]
    texts = docs.filter(F.col(id_col).isin(chosen) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    texts = texts.withColumn("before", before).filter(F.col("before") < bytes_per_language).orderBy("lang", "id", "text")
    return fit([(r["lang"], r["text"]) for r in texts.select("lang", "text").collect()], priors, vocabulary_pieces(vocabulary_path))


class Scorer:
    """Scores texts, keeping the scores of what stands between spaces."""

    def __init__(self, model: dict, most: int = 200_000):
        self.model, self.most = model, most
        self.segmenter = Segmenter(model["pieces"])
        self.prob = model["prob"].astype(np.float64)
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(model["langs"]) + 1))

    def _learn(self, units: list[str]) -> None:
        words: dict[str, int] = {}
        rows, cols = [], []
        for i, unit in enumerate(units):
            for word in words_of(unit):
                rows.append(i)
                cols.append(words.setdefault(word, len(words)))
        scores = np.zeros((len(units), self.prob.shape[1] + 1))
        if words:
            logs = self.segmenter.log_probs(list(words), self.prob)
            full = np.concatenate([logs, np.ones((len(logs), 1))], axis=1)
            np.add.at(scores, np.array(rows), full[np.array(cols)])
        start = len(self.table)
        self.index.update(zip(units, range(start, start + len(units)), strict=True))
        self.table = np.concatenate([self.table, scores])

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        pieces = [text.split() for text in texts]
        wanted = set().union(*pieces) if pieces else set()
        new = [u for u in wanted if u not in self.index]
        if len(self.index) + len(new) > self.most:
            self.index, self.table, new = {}, self.table[:0], list(wanted)
        self._learn(new)
        get = self.index.__getitem__
        sums = np.zeros((len(texts), self.table.shape[1]))
        for i, units in enumerate(pieces):
            if units:
                sums[i] = self.table[list(map(get, units))].sum(axis=0)
        logs = sums[:, :-1] + self.model["prior"]
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        langs = [self.model["langs"][b] if n else "und" for b, n in zip(best, sums[:, -1], strict=True)]
        return langs, np.where(sums[:, -1] > 0, score, 0.0)


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, lang_pred, score (posterior of the language named): one row per document.

    Null, empty and letterless texts: und, score 0. Without a model: und for all. Rows that repeat, and null ids, are
    scored each for itself. Empty table: no rows. Other columns are ignored.

    Scale: no shuffle; the model is of fixed size (pieces times languages) and goes to the executors once; workers
    keep scores of a bounded number of words.
    """
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, lang_pred string, score double"
    if model is None:
        return src.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        scorer = only(key, lambda: Scorer(shared.value))
        for batch in byte_batches(batches, "text"):
            langs, score = scorer.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)
