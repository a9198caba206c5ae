"""Toxicity: a subsequence string kernel under a support vector machine with Nyström landmarks.

Texts become streams of symbols: letters without case and accents, digits as the letters they stand in for, one space for
each run of white space, nothing else. The kernel of two pieces of such a stream sums over all common subsequences of
ORDER symbols within SPAN, each weighing DECAY for every symbol that it skips, so an insult with inserted characters,
dots or spaces still shares most subsequences with the plain one. Landmarks are pieces of labelled texts; the Nyström map
of the kernel to them feeds a linear machine with squared hinge loss. As the kernel is a finite sum over subsequences, the
trained machine folds into one weight for each subsequence (2^20 of them), and a text is scored in one pass: the weights
of all its subsequences are summed over every stretch of PIECE symbols and over every word, and the margins of a text are
those of its worst stretch and of its WORDS worst words. A label belongs to a text, not to a stretch, so training alternates: pick the worst stretch of each text, then
train on them (multiple-instance learning); logistic regression on the margins gives the probability.

Learning is bounded by `bound` labelled rows, outside the held-out fold, and each round trains on at most STRETCHES
stretches of each text of label 1, but for the NOISE lowest of their margins (texts whose label the text itself doesn't show),
and the NEGATIVES * n + 500 worst stretches of texts of label 0, n being the former's number. Scoring reads every text whole.
Labels other than 0 count as 1. Letters beyond the Latin alphabet share five symbols by code point modulo 5, so insults in
other scripts are told apart by fewer symbols. Ids may be of any type that sorts. Null and empty
texts have margin zero. Without labels of both kinds each score is the share of label 1 (0 without any). A score depends
on the text alone, so ties, repeated rows and extra columns make no difference.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.blocks import text_blocks
from docengine.llm.labelled import labelled_sample, remainder
from docengine.llm.staging import staged

BOUND = 20_000
ORDER, SPAN, DECAY = 4, 7, 0.6
PIECE = 16
LANDMARKS = 320
ROUNDS = 3
WORDS = 3
STRETCHES, NEARLY = 4, 0.5
NOISE, NEGATIVES = 0.1, 3
UNIT = 1 << 20
SIZE = 1 << 20  # 32 symbols to the power ORDER
BLOCK = 1_000_000

#: Digits and signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
DROPPED, BLANK = 255, 0
GAPS = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
CLOSE = [g for g in GAPS if g[-1] <= ORDER]
WEIGHTS = [DECAY ** (g[-1] - ORDER + 1) for g in GAPS]


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """0 for white space, 1-26 for letters of the alphabet, 27-31 for all others, DROPPED for the rest."""
    out = np.full(0x30000, DROPPED, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        base = unicodedata.normalize("NFD", STAND_INS.get(c, c))[0].lower()[:1]
        if "a" <= base <= "z":
            out[cp] = ord(base) - 96
        elif c.isspace():
            out[cp] = BLANK
        elif c.isalpha():
            out[cp] = 27 + cp % 5
    return out


def stream(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, PIECE + SPAN blanks after each, and where each begins (n + 1 entries)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(lead, starts)
    symbols = symbol_table()[np.minimum(points, 0x2FFFF)]
    kept = np.flatnonzero(symbols != DROPPED)
    symbols = symbols[kept]
    text = np.searchsorted(bounds, kept, "right") - 1
    single = np.ones(len(symbols), bool)
    single[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK) | (text[1:] != text[:-1])
    symbols, text = symbols[single], text[single]
    n, pad = len(starts) - 1, PIECE + SPAN
    counts = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts + pad)])
    out = np.zeros(first[-1], np.uint8)
    out[np.arange(len(symbols)) + text * pad] = symbols
    return out, first


def subsequence_ids(symbols: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """The id of the subsequence at each place, for one way to skip; along the last axis, which loses SPAN - 1 entries."""
    n = symbols.shape[-1] - SPAN + 1
    out = symbols[..., :n].astype(np.int32)
    for g in gaps[1:]:
        out = (out << 5) | symbols[..., g : g + n]
    return out


def place_weights(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The summed weight of the subsequences that begin at each place."""
    n = len(symbols) - SPAN + 1
    out = np.zeros(n, np.float32)
    wide = symbols.astype(np.int32)
    two = {a: (wide[:n] << 15) | (wide[a : a + n] << 10) for a in range(1, SPAN - 2)}
    for a in two:
        for b in range(a + 1, SPAN - 1):
            three = two[a] | (wide[b : b + n] << 5)
            for c in range(b + 1, SPAN):
                part = weights.take(three | wide[c : c + n])
                out += part if c == ORDER - 1 else part * np.float32(DECAY ** (c - ORDER + 1))
    return out


def stretch_sums(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weight of all subsequences within the stretch of PIECE symbols from each place on."""
    return _stretches(whole_weights(symbols, weights), len(symbols)) / UNIT


def whole_weights(symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """place_weights in whole units, whose running sums are exact: a text's margins don't depend on the texts before it."""
    return np.rint(place_weights(symbols, weights).astype(np.float64) * UNIT).astype(np.int64)


def _stretches(places: np.ndarray, n: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(places)])
    reach = PIECE - SPAN + 1
    out = np.zeros(n, np.int64)
    out[: len(sums) - reach] = sums[reach:] - sums[:-reach]
    return out


def margins(symbols: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each text: the margin of its worst stretch, and of its worst WORDS words (0 where there are fewer)."""
    n = len(first) - 1
    out = np.zeros((n, 1 + WORDS))
    if not n:
        return out
    places = whole_weights(symbols, weights)
    for k in range(1, SPAN):  # places in the padding that reach into the next text
        places[first[1:-1] - k] = 0
    # A whole piece fits from each place, as in pick().
    own = np.stack([first[:-1], first[1:] - SPAN - PIECE + 1], 1).reshape(-1)
    out[:, 0] = np.maximum.reduceat(_stretches(places, len(symbols)), own)[::2] / UNIT
    inside = np.concatenate([symbols != BLANK, [False]])
    begin = np.flatnonzero(inside[:-1] & ~np.concatenate([[False], inside[:-2]])) if len(symbols) > 1 else np.zeros(0, np.int64)
    if not len(begin):
        return out
    cuts = np.union1d(begin, first[:-1])  # a text's last word ends with the text
    word = np.add.reduceat(np.concatenate([places, np.zeros(SPAN, np.int64)]), cuts)[np.searchsorted(cuts, begin)] / UNIT
    text = np.searchsorted(first, begin, "right") - 1
    order = np.lexsort((-word, text))
    place = np.arange(len(order)) - np.searchsorted(text, text[order])
    for k in range(WORDS):
        at = order[place == k]
        out[text[at], 1 + k] = np.maximum(word[at], 0)
    return out


def features(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and weights of all subsequences of each piece (rows of PIECE symbols)."""
    ids = [subsequence_ids(pieces, g) for g in GAPS]
    return np.concatenate(ids, 1), np.repeat(np.array(WEIGHTS, np.float32), [i.shape[1] for i in ids])


def kernel(pieces: np.ndarray, landmarks: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """k(piece, landmark) / sqrt(k(landmark, landmark)), each subsequence weighing rarity[id] squared."""
    ids, weight = features(landmarks)
    known, inverse = np.unique(ids, return_inverse=True)
    inverse = inverse.reshape(ids.shape)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for j in range(len(landmarks)):
        np.add.at(table[:, j], inverse[j], weight)
    table[:-1] *= rarity[known][:, None]
    table /= np.maximum(np.sqrt((table**2).sum(0)), 1e-9)
    table[:-1] *= rarity[known][:, None]
    out = np.zeros((len(pieces), len(landmarks)), np.float32)
    for k in range(0, len(pieces), 100):
        ids, weight = features(pieces[k : k + 100])
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        hit = known[at] == ids
        row, column = np.nonzero(hit)
        if len(row):
            values = table[at[row, column]] * weight[column][:, None]
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            out[k + row[begins]] = np.add.reduceat(values, begins, 0)
    return out


def train_machine(pieces: np.ndarray, y: np.ndarray, landmarks: np.ndarray, rarity: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of all subsequences: a linear machine on the Nyström map, folded back."""
    gram = kernel(landmarks, landmarks, rarity).astype(np.float64)
    ids, weight = features(landmarks)
    norms = np.empty(len(landmarks))
    phi = []
    for j in range(len(landmarks)):
        known, inverse = np.unique(ids[j], return_inverse=True)
        value = np.bincount(inverse, weight) * rarity[known]
        norms[j] = max(np.sqrt((value**2).sum()), 1e-9)
        phi.append((known, value * rarity[known] / norms[j]))
    values, vectors = np.linalg.eigh((gram / norms[:, None] + (gram / norms[:, None]).T) / 2)
    kept = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    x = kernel(pieces, landmarks, rarity).astype(np.float64) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    each = np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1)) / 2
    damp = np.append(np.full(x.shape[1] - 1, ridge), 1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton's steps on the squared hinge loss
        active = y * (x @ w) < 1
        held = x[active] * each[active][:, None]
        new = np.linalg.solve(held.T @ x[active] + np.diag(damp), held.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    beta = root @ w[:-1]
    out = np.zeros(SIZE, np.float32)
    for b, (known, value) in zip(beta, phi):
        out[known] += (b * value).astype(np.float32)
    out[0] = 0
    return out


@dataclass
class Model:
    weights: np.ndarray  # of SIZE subsequences: 4 MB
    slopes: np.ndarray
    offset: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margins @ self.slopes + self.offset, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset by Newton's method, with Platt's smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = x.std(0) + 1e-9
    x = np.concatenate([x / scale, np.ones((len(y), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w), -3, 3)
    return w[:-1] / scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = BOUND) -> Model:
    sample = staged(labelled_sample(docs, labels, label, bound).repartition(12))
    id_field = sample.schema["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE), np.int32)  # texts of each label that have the subsequence, little skipped
        for block in text_blocks(batches, limit=BLOCK):
            symbols, first = stream(block.data, block.starts)
            y = block.batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, kind in zip(first[:-1], first[1:], y):
                total[kind, np.unique(np.concatenate([subsequence_ids(symbols[a:b], g) for g in CLOSE]))] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["id", "n0", "n1"])

    counts = sample.select("doc_id", "text", "label").mapInArrow(count, "id int, n0 int, n1 int").groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        share = min(max(totals.get(1, 0) / max(sum(totals.values()), 1), 1e-3), 1 - 1e-3)
        return Model(np.zeros(SIZE, np.float32), np.zeros(1 + WORDS), float(np.log(share / (1 - share))))
    found = np.array(counts.collect(), np.int64).reshape(-1, 3)  # SIZE rows at most
    rarity, weights = np.ones(SIZE, np.float32), np.zeros(SIZE, np.float32)
    rarity[found[:, 0]] = 1 - np.log1p(found[:, 1]) / np.log1p(totals[0])
    odds = np.log((found[:, 2] + 1) / (totals[1] + 2)) - np.log((found[:, 1] + 1) / (totals[0] + 2)) - 0.7
    weights[found[:, 0]] = np.maximum(odds, 0) * (found[:, 2] > 1)
    rarity[0] = weights[0] = 0

    def pick(weights: np.ndarray) -> list:
        """The worst stretch of each text, up to STRETCHES nearly as bad ones of texts of label 1, and one other of each text
        of label 0."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, limit=BLOCK):
                symbols, first = stream(block.data, block.starts)
                sums = stretch_sums(symbols, weights)
                ids, y, draws, out = *(block.batch.column(k).to_pylist() for k in (0, 2, 3)), []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    own, most = sums[a : b - SPAN - PIECE + 1].astype(np.float64), None  # a whole piece fits from each place
                    for _ in range(STRETCHES if y[i] == 1 else 1):
                        at = int(own.argmax())
                        if most is not None and own[at] < NEARLY * most:
                            break
                        most = own[at] if most is None else most
                        out.append((ids[i], y[i], symbols[a + at : a + at + PIECE].tobytes(), float(own[at])))
                        own[max(0, at - PIECE + 1) : at + PIECE] = -np.inf
                    if y[i] == 0:
                        other = a + draws[i] % max(1, b - a - PIECE - SPAN)
                        out.append((ids[i], -1, symbols[other : other + PIECE].tobytes(), 0.0))
                if out:
                    found, kinds, some, margin = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(found, block.batch.schema.field(0).type), pa.array(kinds), pa.array(some), pa.array(margin)], ["doc_id", "label", "piece", "margin"])

        draw = F.pmod(F.xxhash64("doc_id", F.lit("stretch")), F.lit(1 << 40)).alias("draw")
        return sorted(sample.select("doc_id", "text", "label", draw).mapInArrow(run, T.StructType([id_field, *T.StructType.fromDDL("label long, piece binary, margin double")])).collect())

    for _ in range(ROUNDS):
        rows = pick(weights)  # at most STRETCHES pieces for each of `bound` rows
        pieces = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
        kind, margin = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
        bad = np.flatnonzero(kind == 1)
        bad = bad[margin[bad] >= np.quantile(margin[bad], NOISE)]
        good = np.flatnonzero(kind != 1)
        good = good[np.argsort(-margin[good], kind="stable")[: NEGATIVES * len(bad) + 500]]
        chosen = np.concatenate([bad, good])
        spread = lambda x, n: x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
        landmarks = np.unique(pieces[np.concatenate([spread(bad, LANDMARKS * 3 // 4), spread(good, LANDMARKS // 4)])], axis=0)
        weights = train_machine(pieces[chosen], np.where(kind[chosen] == 1, 1.0, -1.0), landmarks, rarity)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK):
            rows = margins(*stream(block.data, block.starts), weights)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(2), pa.array(rows.tolist())], ["doc_id", "label", "x"])

    rows = sorted(sample.select("doc_id", "text", "label").mapInArrow(measure, T.StructType([id_field, *T.StructType.fromDDL("label int, x array<double>")])).collect())
    return Model(weights, *logistic(np.array([r[2] for r in rows]), np.array([r[1] for r in rows])))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score (0 to 1) of every whole text."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in text_blocks(batches, limit=BLOCK):
            p = m.probability(margins(*stream(block.data, block.starts), m.weights))
            yield pa.RecordBatch.from_arrays([*block.batch.columns[:-1], pa.array(p)], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned outside the fold crc32(doc_id) mod 5 = 0."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label, bound))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text, BLOCK):
            p = shared.value.probability(margins(*stream(block.data, block.starts), shared.value.weights))
            yield block.batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
