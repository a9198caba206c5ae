"""Benchmark decontamination: fingerprints of item-sized windows, then exact weighted similarity.

For each benchmark item, every stretch of a document as long as the item (in words) is a window; a document with fewer words
than the item is one window, its whole text. A window leaks the item if their weighted Jaccard similarity over distinct
runs of SHINGLE words is at least SIMILARITY; a run weighs more the fewer items have it, counted over the distinct texts of
the whole benchmark.

Fingerprints propose: windows get SimHash fingerprints of BITS bits over their weighted runs, and a multi-index of the
items' fingerprints gives every item within RADIUS of a window. Its BLOCKS blocks have BLOCK_BITS bits; of fingerprints
within RADIUS, one block at least differs in ITEM_FLIPS + WINDOW_FLIPS bits or less (RADIUS < BLOCKS * (flips + 1)), so
items are entered under all values within ITEM_FLIPS bits of theirs, and windows look up all values within WINDOW_FLIPS.
The proposed pairs are verified exactly. A window whose runs of items of its size (any of them) weigh less than SIMILARITY of
its own weight, or of the lightest such item, is similar to no item; it gets no fingerprint, which loses nothing. The radius
is the method's own limit: two texts of similarity 0.8 differ in some 19 of 128 bits, with a deviation of 4.

All sums over windows come from running sums over a text, so the work grows with the text's and not with the windows'
size, and items of any length are taken whole. Words are runs of anything but white space, A-Z lower-cased. A text of fewer
than SHINGLE words has one run, all its words. A limit: an item of fewer than SHINGLE words leaks only where it is a
document's whole text, not where a longer document has it inside. An item without words, or null, is never leaked, and
null and empty documents leak nothing. Items with the same text are all reported; repeated document rows give repeated
rows, null ids are ids like others, and columns other than the id and text pass through `clean` and are left out of `leaks`.
The benchmark is a query set: it is read in slices of at most SLICE items, a broadcast of bounded size each, and each slice
sees all documents. One more broadcast has the runs that several item texts share, with their counts (16 bytes a run); all
others weigh the same, in the benchmark or not, and need no entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.blocks import LOWER, SPACE, KeyTable, mix64, shingle_hashes, slice_hashes, text_blocks, word_bounds

SHINGLE = 5
SIMILARITY = 0.8
BITS, RADIUS = 128, 31
BLOCKS, BLOCK_BITS = 8, 16
ITEM_FLIPS, WINDOW_FLIPS = 1, 2
SLICE = 20_000
BLOCK = 1_000_000
UNIT = 1 << 24  # weights in fingerprints are whole numbers of this part, so that sums are exact
CELLS = 1 << 20  # entries of a temporary matrix


@dataclass
class Weights:
    """Weights of runs over `n` distinct item texts: `runs` are those that `counts` (two or more) of them have."""

    n: int
    runs: np.ndarray
    counts: np.ndarray
    table: KeyTable = field(default=None)

    def of(self, runs: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = KeyTable(self.runs, self.counts, 1)
        return np.log1p(self.n / self.table.get(runs))


@lru_cache(maxsize=4)
def flips(upto: int) -> np.ndarray:
    """All values of BLOCK_BITS bits of which `upto` at most are set."""
    return np.array([sum(1 << b for b in some) for k in range(upto + 1) for some in combinations(range(BLOCK_BITS), k)], np.int64)


def block_keys(prints: np.ndarray, upto: int) -> np.ndarray:
    """(block, value) as one number, for each fingerprint, block and flip."""
    values = prints.view(np.uint16).reshape(len(prints), BLOCKS, 1).astype(np.int64)
    return (np.arange(BLOCKS)[:, None] << BLOCK_BITS) | (values ^ flips(upto))


@dataclass
class Items:
    """A slice of the benchmark. Items of equal size and runs are one class; class c's distinct runs lie in `runs` from
    first[c] to first[c + 1], sorted; ids[c] are its items, `totals` the runs' weights, `prints` the fingerprints."""

    ids: list[list]
    sizes: np.ndarray
    first: np.ndarray
    runs: np.ndarray
    totals: np.ndarray
    prints: np.ndarray
    known: Weights

    def apart(self) -> "Items":
        """The same without `known`, which has a broadcast of its own."""
        return replace(self, known=None)

    def build(self, known: Weights | None = None) -> "Items":
        """Lookup structures: the set of all runs, with the sizes of their items, the least weight of each size, and the multi-index."""
        self.known = known or self.known
        order = np.lexsort((self.totals, self.sizes))
        self.lengths, at = np.unique(self.sizes[order], return_index=True)
        self.least = self.totals[order][at]
        distinct, inverse = np.unique(self.runs, return_inverse=True)
        self.table = KeyTable(distinct, np.arange(len(distinct)), len(distinct))
        bit = np.uint64(1) << (np.searchsorted(self.lengths, self.sizes) % 64).astype(np.uint64)
        self.marks = np.zeros(len(distinct) + 1, np.uint64)  # of which sizes are the items that have a run; 64 bits, shared by more sizes
        np.bitwise_or.at(self.marks, inverse, np.repeat(bit, np.diff(self.first)))
        keys = block_keys(self.prints, ITEM_FLIPS).reshape(-1)
        by_key = np.argsort(keys, kind="stable")
        self.entries = (by_key // max(1, BLOCKS * len(flips(ITEM_FLIPS)))).astype(np.int32)
        self.buckets = np.searchsorted(keys[by_key], np.arange((BLOCKS << BLOCK_BITS) + 1)).astype(np.int32)
        return self

    def near(self, prints: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, class) within RADIUS whose size is from lowest[window] to highest[window]."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = 64
        for k in range(0, len(prints), step):
            keys = block_keys(prints[k : k + step], WINDOW_FLIPS).reshape(-1)
            begin, many = self.buckets[keys], self.buckets[keys + 1] - self.buckets[keys]
            hit = np.flatnonzero(many)
            counts = many[hit].astype(np.int64)
            place = np.arange(counts.sum()) + np.repeat(begin[hit] - (np.cumsum(counts) - counts), counts)
            found = self.entries[place]
            window = np.repeat(k + hit // (BLOCKS * len(flips(WINDOW_FLIPS))), counts)
            fits = (self.sizes[found] >= lowest[window]) & (self.sizes[found] <= highest[window])
            pairs = np.unique(window[fits] * np.int64(len(self.sizes)) + found[fits])
            w, c = pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes))
            close = np.bitwise_count(prints[w] ^ self.prints[c]).sum(1) <= RADIUS
            out.append((w[close], c[close]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def signs(runs: np.ndarray) -> np.ndarray:
    """+1 or -1 for each run and bit."""
    return np.concatenate([np.unpackbits(mix64(runs + np.uint64(k)).view(np.uint8).reshape(-1, 8), axis=1) for k in (1, 2)], 1).astype(np.int8) * 2 - 1


def units(weights: np.ndarray) -> np.ndarray:
    return np.rint(weights * UNIT).astype(np.int64)


def window_sums(values: np.ndarray, previous: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """For windows values[s : s + width], the sum over their distinct runs. previous[p]: where p's run stood before, or -1;
    a run counts in the windows that hold its place p but not the one before. Along the last axis."""
    n = values.shape[-1]
    begin = np.maximum(np.maximum(previous + 1, np.arange(n) - width + 1), 0)
    some = np.arange(n) - begin >= 0
    change = np.zeros((*values.shape[:-1], n + 1), values.dtype)
    if values.ndim == 1:
        change[: n + 1] = np.bincount(begin[some], values[some], minlength=n + 1)
        change[1:] -= np.where(some, values, 0)
    else:
        order = np.argsort(begin[some], kind="stable")
        at, first = np.unique(begin[some][order], return_index=True)
        change[:, at] = np.add.reduceat(values[:, some][:, order], first, 1) if len(at) else 0
        change[:, 1:] -= np.where(some, values, 0)
    return np.cumsum(change, -1)[..., starts]


def fingerprints(runs: np.ndarray, weights: np.ndarray, previous: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of the distinct runs of each window runs[s : s + width]: rows of two 64-bit integers."""
    bits = np.zeros((BITS, len(starts)), bool)
    every, whole = signs(runs).T, units(weights)
    step = max(1, CELLS // (len(runs) + 1))
    for k in range(0, BITS, step):
        bits[k : k + step] = window_sums(every[k : k + step] * whole, previous, width, starts) > 0
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64).reshape(-1, 2)


def previous_places(runs: np.ndarray) -> np.ndarray:
    """For each run, the place where the same one stood before, or -1."""
    order = np.argsort(runs, kind="stable")
    out = np.full(len(runs), -1, np.int64)
    same = runs[order[1:]] == runs[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of SHINGLE words; runs and words before each text."""
    low = LOWER[data]
    begin, end, words = word_bounds(low, starts, ~SPACE)
    hashes, before = shingle_hashes(slice_hashes(low, begin, end), words, SHINGLE)
    return hashes, before, words


def item_runs(text: str) -> tuple[int, np.ndarray]:
    """An item's number of words and its distinct runs, sorted."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashes, _, words = runs_of(raw, np.array([0, len(raw)]))
    return int(words[-1]), np.unique(hashes)


def run_weights(benchmark: DataFrame) -> Weights:
    """Weights over the whole benchmark; texts with the same words count once."""
    low = F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x09-\\x0D ]+", " ")
    texts = benchmark.where("text is not null").select(F.trim(low).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                runs = item_runs(text)[1]
                if len(runs):  # a null stands for the item itself
                    yield pa.RecordBatch.from_arrays([pa.array([None, *runs.view(np.int64).tolist()], pa.int64())], ["run"])

    found = texts.mapInArrow(run, "run long").groupBy("run").count().where("count > 1 or run is null").toArrow()
    run, count = found.column(0).combine_chunks(), found.column(1).combine_chunks()
    inside = run.is_valid()
    n = count.filter(run.is_null())
    return Weights(n[0].as_py() if len(n) else 0, run.filter(inside).to_numpy().view(np.uint64), count.filter(inside).to_numpy())


def load_items(rows: list[tuple], known: Weights | None = None) -> Items:
    """Items of (item_id, text) rows, weighed by `known` or else over these rows alone."""
    classes: dict[tuple, tuple[list, int, np.ndarray]] = {}
    for item, text in rows:
        size, runs = item_runs(text)
        if size:
            classes.setdefault((size, runs.tobytes()), ([], size, runs))[0].append(item)
    ids, sizes, parts = [[c[k] for c in classes.values()] for k in range(3)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    runs = np.concatenate([*parts, np.zeros(0, np.uint64)])
    if known is None:
        every, counts = np.unique(runs, return_counts=True)
        known = Weights(len(parts), every[counts > 1], counts[counts > 1])
    weights = known.of(runs)
    totals = np.array([weights[a:b].sum() for a, b in zip(first[:-1], first[1:])])
    none = np.zeros((0, 2), np.uint64)
    prints = [fingerprints(p, known.of(p), np.full(len(p), -1), len(p), np.zeros(1, np.int64)) for p in parts]
    return Items(ids, np.array(sizes, np.int64), first, runs, totals, np.concatenate([none, *prints]), known)


def text_leaks(items: Items, hashes: np.ndarray, n_words: int, known: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(class, first word, words, similarity) of the best window of each class that a text leaks; known: each run's marks,
    0 for runs of no item."""
    every = np.flatnonzero(known)
    weights, previous = items.known.of(hashes), previous_places(hashes)
    limit, best = SIMILARITY - 1e-9, {}
    most = weights[every][previous[every] < 0].sum()  # no window's known runs weigh more

    def compare(width: int, low: int, starts: np.ndarray, lowest: int, highest: int) -> None:
        """Windows of `width` runs at `starts`, within the stretch that begins at `low`, against classes of these sizes."""
        part = slice(low, int(starts[-1]) + width)
        runs, weight, before = hashes[part], weights[part], previous[part] - low
        at = starts - low
        prints = fingerprints(runs, weight, before, width, at)
        window, found = items.near(prints, np.full(len(at), lowest), np.full(len(at), highest))
        if not len(found):
            return
        own = window_sums(weight, before, width, at)
        order = np.argsort(found, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(found[order])) + 1):
            c, some = int(found[group[0]]), window[group]
            inside = np.isin(runs, items.runs[items.first[c] : items.first[c + 1]])
            shared = window_sums(np.where(inside, weight, 0.0), before, width, at[some])
            similarity = shared / (own[some] + items.totals[c] - shared)
            top = int(np.lexsort((starts[some], -np.round(similarity, 9)))[0])
            if similarity[top] >= limit:
                value = (round(float(similarity[top]), 9), -int(starts[some[top]]))
                best[c] = max(best.get(c, value), value)

    for k, (size, least) in enumerate(zip(items.lengths.tolist(), items.least.tolist())):
        if most < limit * least or size > n_words or size < SHINGLE and size != n_words:
            continue
        width = max(1, size - SHINGLE + 1)  # runs of a window
        # Only windows that hold a run of an item of this size: those from just before the first one to the last.
        places = every[(known[every] >> np.uint64(k % 64)) & np.uint64(1) > 0]
        if weights[places].sum() < limit * least:
            continue
        low, high = max(0, int(places[0]) - width + 1), min(len(hashes), int(places[-1]) + width)
        if high - low < width:
            continue
        hit = np.zeros(high - low)
        hit[places - low] = weights[places]
        starts = np.arange(high - low - width + 1)
        before = previous[low:high] - low
        met, own = window_sums(hit, before, width, starts), window_sums(weights[low:high], before, width, starts)
        starts = starts[(met >= limit * least) & (met >= limit * own)] + low
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1) if len(starts) else ():
            compare(width, int(group[0]), group, size, size)
    if n_words >= SHINGLE and len(items.lengths) and items.lengths[-1] > n_words and most >= limit * weights[previous < 0].sum():
        compare(len(hashes), 0, np.zeros(1, np.int64), n_words + 1, int(items.lengths[-1]))
    return [(c, -start, min(int(items.sizes[c]), n_words), s) for c, (s, start) in sorted(best.items())]


def _block_leaks(items: Items, block) -> dict[int, list[tuple[int, int, int, float]]]:
    """Leaks of the texts of a block, by row."""
    hashes, before, words = runs_of(block.data, block.starts)
    known = items.marks[items.table.get(hashes)]
    some = np.unique(np.searchsorted(before, np.flatnonzero(known), "right") - 1)
    out = {}
    for row in some.tolist():
        a, b = before[row], before[row + 1]
        if found := text_leaks(items, hashes[a:b], int(words[row + 1] - words[row]), known[a:b]):
            out[row] = found
    return out


def slices(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The benchmark's rows, at most SLICE at a time."""
    part = []
    for row in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        part.append((row[0], row[1]))
        if len(part) == SLICE:
            yield part
            part = []
    yield part


def shared_weights(benchmark: DataFrame) -> tuple[Weights, Broadcast]:
    """The weights of all runs, and their broadcast to all slices."""
    known = run_weights(benchmark)
    return known, benchmark.sparkSession.sparkContext.broadcast(Weights(known.n, known.runs, known.counts))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each item that a document leaks."""
    known, weights = shared_weights(benchmark)
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *(T.StructField(n, t) for n, t in (("first_word", T.LongType()), ("n_words", T.LongType()), ("similarity", T.DoubleType())))])
    item_type = T.StructType([benchmark.schema["item_id"]])
    out = None
    for part in slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(load_items(part, known).apart())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            items, kind = shared.value.build(weights.value), to_arrow_schema(item_type).field(0).type
            for block in text_blocks(batches, text, BLOCK):
                rows = [(r, item, *x) for r, found in _block_leaks(items, block).items() for c, *x in found for item in items.ids[c]]
                if rows:
                    at, item, start, n, similarity = zip(*rows)
                    ids = block.batch.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, kind), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([round(s, 6) for s in similarity])], schema.names)

        found = docs.select("doc_id", text).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, that leak no item."""
    known, weights = shared_weights(benchmark)
    for part in slices(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(load_items(part, known).apart())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value.build(weights.value)
            for block in text_blocks(batches, text, BLOCK):
                bad = _block_leaks(items, block)
                yield block.batch.filter(pa.array([i not in bad for i in range(block.n)])) if bad else block.batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE_SQL = f"""
WITH low AS (SELECT 'd' AS k, row_number() OVER () AS r, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM benchmark),
g AS (SELECT k, r, id, len(ws) AS n, p - 1 AS p, array_to_string(ws[p:p + {SHINGLE - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS p FROM low WHERE len(ws) > 0)),
it AS (SELECT DISTINCT r AS i, id AS item_id, n AS size, greatest(n - {SHINGLE - 1}, 1) AS width, g FROM g WHERE k = 'i'),
texts AS (SELECT min(r) AS i FROM low WHERE k = 'i' AND len(ws) > 0 GROUP BY ws),
ni AS (SELECT count(*) AS n FROM texts),
wt AS (SELECT g, ln(1 + n / count(*)) AS w FROM it JOIN texts USING (i), ni GROUP BY g, n),
tot AS (SELECT i, sum(w) AS total FROM it JOIN wt USING (g) GROUP BY i),
hit AS (SELECT d.r, d.id AS doc_id, d.n, d.p, it.i, item_id, least(size, d.n) AS size, least(width, greatest(d.n - {SHINGLE - 1}, 1)) AS width FROM g d JOIN it ON d.k = 'd' AND d.g = it.g WHERE size >= {SHINGLE} OR size = d.n),
win AS (SELECT DISTINCT r, doc_id, i, item_id, size, width, s FROM (SELECT *, unnest(range(greatest(p - width + 1, 0), least(p, greatest(n - {SHINGLE - 1}, 1) - width) + 1)) AS s FROM hit)),
runs AS (SELECT DISTINCT win.r, doc_id, win.i, item_id, size, s, d.g FROM win JOIN g d ON d.k = 'd' AND d.r = win.r AND d.p BETWEEN s AND s + width - 1),
sim AS (SELECT runs.r, doc_id, runs.i, runs.item_id, runs.size, s, sum(coalesce(w, ln(1 + ni.n))) AS own, coalesce(sum(w) FILTER (it.g IS NOT NULL), 0) AS shared FROM runs CROSS JOIN ni LEFT JOIN wt ON wt.g = runs.g LEFT JOIN it ON it.i = runs.i AND it.g = runs.g GROUP BY ALL)
SELECT doc_id, item_id, s::BIGINT AS first_word, size::BIGINT AS n_words, round(similarity, 6) AS similarity
FROM (SELECT *, shared / (own + total - shared) AS similarity FROM sim JOIN tot USING (i)) WHERE similarity >= {SIMILARITY} - 1e-9
QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY round(similarity, 9) DESC, s) = 1"""
