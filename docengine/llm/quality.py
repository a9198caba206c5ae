"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each token has a fixed sparse ternary index vector; a vocabulary entry's word vector is the sum of the index vectors that
stand near it in the labelled sample, turned by their distance. A document's vector is the mean of its tokens' word
vectors, next to a few pooled channels (how often a token repeats the one or two before it, token length, share of words
out of vocabulary, number of tokens). A two-layer numpy network gives a logit, which a temperature fitted on a part of
the sample that the network has not seen turns into a probability.

Learning is bounded: `bound` labelled rows, `VOCABULARY` entries of `DIMENSION` floats. Scoring reads every text whole.
Null and empty texts have a zero vector and get the network's score for it. Without labels of both kinds, each score is
the share of label 1 (0.5 without any). Labels other than 0 count as 1; ids may be of any type that sorts. Ties, repeated rows and extra columns make no difference: a score depends on the
text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.blocks import LOWER, KeyTable, mix64, slice_hashes, text_blocks
from docengine.llm.labelled import labelled_sample, remainder
from docengine.llm.staging import staged

BOUND = 20_000
VOCABULARY = 20_000
DIMENSION = 64
NONZERO = 6
WINDOW = 2
CHANNELS = 5
BLOCK = 500_000

#: Kinds of bytes: 0 white space, 1 word (letters, digits, all beyond ASCII), else the byte itself; line ends count as signs.
KIND = np.arange(256, dtype=np.uint8)
KIND[[9, 11, 12, 13, 32]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1
UPPER, DIGIT = np.zeros(256, np.int32), np.zeros(256, np.int32)
UPPER[65:91] = DIGIT[48:58] = 1
SHAPES = 5  # lower case, capitalised, upper case, digits, signs


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (hash of the lower-cased form and shape), shapes and lengths of all tokens; tokens before each text."""
    kind = KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    kept = kind[begin] != 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[kept], end[kept]
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(DIGIT[data])])
    length, capitals = end - begin, upper[end] - upper[begin]
    shape = np.where(capitals == 0, 0, np.where((capitals == length) & (length > 1), 2, 1))
    shape[digit[end] - digit[begin] == length] = 3
    shape[kind[begin] != 1] = 4
    keys = slice_hashes(LOWER[data], begin, end) ^ mix64(shape.astype(np.uint64) + np.uint64(11))
    return keys, shape, length, np.searchsorted(begin, starts)


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """The sparse ternary index vector of each key, drawn from the key itself."""
    out = np.zeros((len(keys), DIMENSION), np.float32)
    rows = np.arange(len(keys))
    for k in range(NONZERO):
        h = mix64(keys + np.uint64(1 + k))
        out[rows, (h >> np.uint64(8)) % np.uint64(DIMENSION)] += np.where(h & np.uint64(1), 1, -1)
    return out


def vocabulary_ids(vocab: KeyTable, size: int, keys: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Row of each token's word vector; tokens out of vocabulary share a row for each shape."""
    found = vocab.get(keys)
    return np.where(found < 0, size + shape, found)


@dataclass
class Model:
    keys: np.ndarray
    vectors: np.ndarray
    weights: tuple[np.ndarray, ...]
    centre: np.ndarray
    spread: np.ndarray
    temperature: float

    def features(self, vocab: KeyTable, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        keys, shape, length, before = tokens(data, starts)
        n = len(starts) - 1
        out = np.zeros((n, DIMENSION + CHANNELS), np.float32)
        ids = vocabulary_ids(vocab, len(self.keys), keys, shape)
        full = np.flatnonzero(before[:-1] < before[1:])
        if not len(full):
            return out
        where = before[:-1][full]
        counts = np.diff(before)[full]
        # A text's own tokens only: comparisons across the first one or two tokens of a text are void.
        place = np.arange(len(keys)) - np.repeat(where, counts)
        same = [np.concatenate([np.zeros(k, bool), keys[k:] == keys[:-k]])[: len(keys)] & (place >= k) for k in (1, 2)]
        channels = np.stack([same[0], same[1], np.minimum(length, 40) / 10, ids >= len(self.keys)], 1).astype(np.float32)
        sums = np.add.reduceat(np.concatenate([self.vectors[ids], channels], 1), where, 0)
        out[full, : sums.shape[1]] = sums / counts[:, None]
        out[full, -1] = np.log1p(counts) / 5
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(logits(self.weights, (x - self.centre) / self.spread) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logits(weights, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return np.tanh(x.astype(np.float64) @ w1 + b1) @ w2 + b2


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 7):
    """Adam on mini-batches of the logistic loss."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 256):
            part = order[k : k + 256]
            w1, b1, w2, b2 = weights
            h = np.tanh(x[part] @ w1 + b1)
            d = (sigmoid(h @ w2 + b2) - y[part]) / len(part)
            back = np.outer(d, w2) * (1 - h * h)
            grads = [x[part].T @ back + decay * w1, back.sum(0), h.T @ d + decay * w2, d.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (1 - epoch / epochs) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss."""
    if not len(z):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = BOUND) -> Model:
    sample = staged(labelled_sample(docs, labels, label, bound).repartition(12))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            found, n = np.unique(tokens(block.data, block.starts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = sample.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 5").orderBy(F.desc("n"), "key").limit(VOCABULARY).select("key").collect()
    keys = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    size = len(keys) + SHAPES

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = KeyTable(keys, np.arange(len(keys)), -1), np.zeros((size, DIMENSION), np.float32)
        rows = np.concatenate([index_vectors(keys), index_vectors(np.arange(SHAPES, dtype=np.uint64) + np.uint64(101))])
        for block in text_blocks(batches, limit=BLOCK):
            k, shape, _, before = tokens(block.data, block.starts)
            ids, text = vocabulary_ids(vocab, len(keys), k, shape), np.repeat(np.arange(block.n), np.diff(before))
            for far in range(1, WINDOW + 1):
                inside = text[far:] == text[:-far]
                left, right = ids[:-far][inside], ids[far:][inside]
                np.add.at(total, right, np.roll(rows, far, 1)[left])
                np.add.at(total, left, np.roll(rows, -far, 1)[right])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = sample.select("text").mapInArrow(contexts, "part binary").collect()  # 12 matrices of `size` rows
    vectors = sum((np.frombuffer(r[0], np.float32).reshape(size, DIMENSION).astype(np.float64) for r in parts), np.zeros((size, DIMENSION)))
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    width = DIMENSION + CHANNELS
    model = Model(keys, vectors, (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.zeros(())), np.zeros(width), np.ones(width), 1.0)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = KeyTable(model.keys, np.arange(len(model.keys)), -1)
        for block in text_blocks(batches, limit=BLOCK):
            x = model.features(vocab, block.data, block.starts)
            yield pa.RecordBatch.from_arrays([block.batch.column(0), block.batch.column(2), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "label", "x"])

    rows = sorted(sample.select("doc_id", "text", "label").mapInArrow(featurise, T.StructType([sample.schema["doc_id"], *T.StructType.fromDDL("label int, x binary")])).collect())
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        model.weights = (*model.weights[:3], np.array(np.log(share / (1 - share))))
        return model
    x = np.stack([np.frombuffer(r[2], np.float32) for r in rows])
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    z = ((x - model.centre) / model.spread).astype(np.float64)
    calibrate = np.arange(len(y)) % 5 == 4
    model.weights = train_network(z[~calibrate], y[~calibrate])
    model.temperature = fit_temperature(logits(model.weights, z[calibrate]), y[calibrate])
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and score (0 to 1) of every whole text."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 5 MB: VOCABULARY rows of DIMENSION floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocab = KeyTable(m.keys, np.arange(len(m.keys)), -1)
        for block in text_blocks(batches, limit=BLOCK):
            p = m.probability(m.features(vocab, block.data, block.starts))
            yield pa.RecordBatch.from_arrays([*block.batch.columns[:-1], pa.array(p)], schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned outside the fold crc32(doc_id) mod 5 = 0."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, label, bound))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
