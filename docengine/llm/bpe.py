"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The texts of a block become one array of code points. Every code point gets a symbol of a small alphabet (letter, number,
space, contraction letter, ...), and the pre-tokenisation pattern becomes an automaton of eight states over that alphabet.
A symbol is a function from states to states, and such functions compose associatively: the block is cut into stripes,
all stripes compose their functions at once, a scan over the stripes gives each one's first state, and a second pass
marks the slices' first characters. No regular expression runs. Equal slices of a block are merged once, and a worker
keeps the merged ids of the slices that it has seen. Encoding keeps the byte offset of each slice's end in its text next
to the ids, so that any slice can be decoded alone.

Null texts count as empty: no ids, and empty bytes when decoded. Repeated rows give repeated rows; an empty table gives
an empty one; further columns pass through `encode` unchanged unless their names are those it adds, which it replaces.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docengine.llm.blocks import KeyTable, slice_hashes, text_blocks

CACHE_SLICES = 200_000
STRIPE = 128

# The letters that follow an apostrophe in the pattern's contractions, and Unicode's White_Space.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols; a text's first character has the symbol + RESET.
LETTER, ONE, TWO, NUMBER, OTHER, APOSTROPHE, BLANK, WHITE, LAST_BLANK, LAST_WHITE = range(10)
RESET, SYMBOLS = 16, 32
# States: what the character before has left open.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_WHITE, AT_APOSTROPHE, IN_TWO = range(8)


@lru_cache(maxsize=1)
def code_point_kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER, APOSTROPHE, BLANK or WHITE for each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = NUMBER
    kinds[WHITE_SPACE] = WHITE
    kinds[0x20], kinds[0x27] = BLANK, APOSTROPHE
    return kinds


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[state * 32 + symbol]: the next state; opens[...]: does that character begin a slice."""
    step, opens = np.zeros(8 * SYMBOLS, np.uint8), np.zeros(8 * SYMBOLS, bool)
    run = {LETTER: IN_LETTERS, ONE: IN_LETTERS, TWO: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: IN_OTHERS}
    for state in range(8):
        for symbol in range(10):
            for reset in (0, RESET):
                s = FRESH if reset else state
                if symbol in (BLANK, WHITE, LAST_BLANK, LAST_WHITE):
                    last = symbol in (LAST_BLANK, LAST_WHITE)
                    begins = last or s != IN_WHITE
                    to = AFTER_BLANK if symbol == LAST_BLANK else FRESH if symbol == LAST_WHITE else IN_WHITE
                elif s == IN_TWO:  # the second letter of re, ve, ll
                    begins, to = False, FRESH
                elif s == AT_APOSTROPHE and symbol in (ONE, TWO):
                    begins, to = False, FRESH if symbol == ONE else IN_TWO
                else:
                    # An apostrophe opens a contraction where a slice begins at it.
                    to = run[symbol]
                    before = IN_OTHERS if s == AT_APOSTROPHE else s
                    begins = before not in (to, AFTER_BLANK)
                    if symbol == APOSTROPHE and begins:
                        to = AT_APOSTROPHE
                step[state * SYMBOLS + symbol + reset], opens[state * SYMBOLS + symbol + reset] = to, begins
    return step, opens


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point. `first`: indices at which texts begin."""
    kinds = code_point_kinds()[points]
    following = np.full(len(points), -1, np.int64)
    following[:-1] = points[1:]
    following[first[first > 0] - 1] = -1
    out = kinds.copy()
    after_apostrophe = np.flatnonzero(points[:-1] == 0x27) + 1
    a, b = points[after_apostrophe], following[after_apostrophe]
    for letters in CONTRACTIONS:
        hit = a == ord(letters[0])
        if len(letters) == 2:
            hit &= b == ord(letters[1])
        out[after_apostrophe[hit]] = ONE if len(letters) == 1 else TWO
    white = (kinds == BLANK) | (kinds == WHITE)
    last = white.copy()
    last[:-1] &= ~white[1:]
    last &= following >= 0
    out[last] += LAST_BLANK - BLANK
    out[first] += RESET
    return out


def slice_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points that begin a slice. `first`: where the (non-empty) texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    step, opens = automaton()
    stripes = -(-n // STRIPE)
    flat = np.full(stripes * STRIPE, RESET + OTHER, np.uint8)
    flat[:n] = symbols_of(points, first)
    columns = np.ascontiguousarray(flat.reshape(stripes, STRIPE).T).astype(np.int16)
    functions = np.repeat(np.arange(8, dtype=np.uint8)[:, None], stripes, 1)  # of each stripe: state -> state
    for column in columns:
        functions = step[functions.astype(np.int16) * SYMBOLS + column]
    shift = 1  # an inclusive scan over the stripes' functions: twice the reach in each round
    while shift < stripes:
        functions[:, shift:] = np.take_along_axis(functions[:, shift:], functions[:, :-shift].astype(np.intp), 0)
        shift *= 2
    state = np.concatenate([[0], functions[FRESH, :-1]]).astype(np.int16)
    marks = np.empty((STRIPE, stripes), bool)
    for k, column in enumerate(columns):
        key = state * SYMBOLS + column
        marks[k] = opens[key]
        state = step[key].astype(np.int16)
    return np.flatnonzero(marks.T.reshape(-1)[:n])


NONE = 1 << 30


class Vocabulary:
    """Ranks of a byte-level vocabulary, ready for merging and decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.singles = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = KeyTable(list(pairs), list(pairs.values()), NONE)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.cache: dict[bytes, int] = {}
        self.clear()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE."""
        return self.pairs.get((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))

    def clear(self) -> None:
        """Empty the cache of merged slices; its entries index `store`, from `begin` for `count` ids."""
        self.cache.clear()
        self.store, self.begin, self.count, self.used = np.zeros(1 << 20, np.int32), np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64), 0

    def merge(self, slices: list[bytes]) -> list[np.ndarray]:
        """Ids of each slice: the pair of lowest rank, the leftmost among equals, is merged until no pair is known."""
        out: list = [None] * len(slices)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(slices):
            whole = self.ranks.get(s)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            else:
                by_size.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        for width, rows in by_size.items():
            each = max(1, (1 << 21) // width)
            for k in range(0, len(rows), each):
                part = rows[k : k + each]
                if width > 4096:
                    for i in part:
                        out[i] = self._merge_long(slices[i])
                else:
                    for i, ids in zip(part, self._merge_many([slices[i] for i in part], width)):
                        out[i] = ids
        return out

    def _merge_many(self, slices: list[bytes], width: int) -> list[np.ndarray]:
        """All slices at once, one merge of each in a round. A row: its ids, then padding; ranks[r, j]: of the pair j, j + 1."""
        sizes = np.array([len(s) for s in slices])
        raw = np.frombuffer(b"".join(slices), np.uint8)
        ids = np.zeros((len(slices), width), np.int32)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.singles[raw]
        none = np.int32(NONE)
        ranks = np.full((len(slices), width), none, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.pair_ranks(ids[:, :-1], ids[:, 1:]), none)
        done: list = [None] * len(slices)
        rows = np.arange(len(slices))
        column = np.arange(width - 1)
        while len(rows):
            at = ranks.argmin(1)
            k = np.arange(len(rows))
            best = ranks[k, at]
            stop = best == none
            if stop.any():
                for i in np.flatnonzero(stop):
                    done[rows[i]] = ids[i, : sizes[i]].copy()
                go = ~stop
                ids, ranks, rows, sizes, at, best = ids[go], ranks[go], rows[go], sizes[go], at[go], best[go]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            ids[k, at] = best
            beyond = column > at[:, None]  # what stands behind the merged pair moves left
            ids[:, :-1] = np.where(beyond, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(column >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            sizes = sizes - 1
            left = at > 0
            ranks[k[left], at[left] - 1] = self.pair_ranks(ids[k[left], at[left] - 1], best[left])
            right = at < sizes - 1
            ranks[k[right], at[right]] = self.pair_ranks(best[right], ids[k[right], at[right] + 1])
            ranks[k[~right], at[~right]] = none
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long slice, with a heap over a linked list: n log n steps."""
        import heapq

        none = NONE
        ids = self.singles[np.frombuffer(piece, np.uint8)]
        heap = [(int(r), i, int(a), int(b)) for i, (r, a, b) in enumerate(zip(self.pair_ranks(ids[:-1], ids[1:]), ids[:-1], ids[1:])) if r != none]
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := self.known_pair(rank, ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if (p := before[i]) >= 0 and (r := self.known_pair(ids[p], rank)) is not None:
                heapq.heappush(heap, (r, p, ids[p], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def known_pair(self, a: int, b: int) -> int | None:
        left = self.flat[self.at[a] : self.at[a] + self.lengths[a]].tobytes()
        return self.ranks.get(left + self.flat[self.at[b] : self.at[b] + self.lengths[b]].tobytes())

    def lookup(self, slices: list[bytes]) -> np.ndarray:
        """Entry of each of the slices, which are distinct; unknown ones are merged first."""
        if len(self.cache) > CACHE_SLICES:
            self.clear()
        known = [self.cache.get(s, -1) for s in slices]
        new = [s for s, k in zip(slices, known) if k < 0]
        if new:
            merged = self.merge(new)
            first, sizes = len(self.cache), np.array([len(m) for m in merged])
            total, last = int(sizes.sum()), first + len(new)
            while self.used + total > len(self.store):
                self.store = np.concatenate([self.store, np.zeros_like(self.store)])
            while last > len(self.begin):
                self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
            self.store[self.used : self.used + total] = np.concatenate(merged)
            self.begin[first:last] = self.used + np.cumsum(sizes) - sizes
            self.count[first:last] = sizes
            self.used += total
            self.cache.update(zip(new, range(first, last)))
            fresh = iter(range(first, last))
            known = [next(fresh) if k < 0 else k for k in known]
        return np.array(known, np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... count[i] of them, for each i."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def encode_block(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts end to end; how many each text has; slices' ends in bytes within their text; slices in each text."""
    # Code points from UTF-8: a character begins at each byte that isn't a continuation.
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) != len(points):
        raise ValueError("the text is not UTF-8")
    first = np.searchsorted(lead, starts[:-1][starts[:-1] < starts[1:]])
    begin = lead[slice_starts(points, first)]
    end = np.append(begin[1:], len(data))[: len(begin)]
    before = np.searchsorted(begin, starts)
    codes, distinct = pd.factorize(slice_hashes(data, begin, end))
    one = np.zeros(len(distinct), np.int64)
    one[codes[::-1]] = np.arange(len(codes))[::-1]
    raw = data.tobytes()
    entries = vocab.lookup([raw[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist())])[codes] if len(codes) else np.zeros(0, np.int64)
    count = vocab.count[entries]
    ids = vocab.store[spread(vocab.begin[entries], count)]
    sums = np.concatenate([[0], np.cumsum(count)])
    return ids, sums[before[1:]] - sums[before[:-1]], end - np.repeat(starts[:-1], np.diff(before)), np.diff(before)


def decode_block(vocab: Vocabulary, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and how many each has."""
    sizes = vocab.lengths[ids]
    sums = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    return vocab.flat[spread(vocab.at[ids], sizes)], np.diff(sums[bounds])


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


Batches = Iterator[pa.RecordBatch]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with that column last; a column that has the name already goes."""
    kept = [i for i, c in enumerate(batch.schema.names) if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*(batch.schema.names[i] for i in kept), name])


def id_lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and how many each row has; none for nulls."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def encoding(batches: Batches, vocab_path: str, text: str, ids_to: str = "ids", ends_to: str = "slice_ends") -> Batches:
    vocab = vocabulary(vocab_path)
    for block in text_blocks(batches, text):
        ids, counts, ends, slices = encode_block(vocab, block.data, block.starts)
        yield with_column(with_column(block.batch, ids_to, _lists(ids, counts)), ends_to, _lists(ends, slices))


def decoding(batches: Batches, vocab_path: str, ids: str = "ids", into: str = "decoded") -> Batches:
    vocab = vocabulary(vocab_path)
    for batch in batches:
        if batch.num_rows:
            raw, sizes = decode_block(vocab, *id_lists(batch.column(batch.schema.get_field_index(ids))))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield with_column(batch, into, pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]))


def digesting(batches: Batches, keep: list[str]) -> Batches:
    for batch in batches:
        ids, counts = id_lists(batch.column("ids"))
        raw, ends = ids.astype("<u4"), np.cumsum(counts)
        of_ids = [hashlib.sha256(raw[b - n : b]).hexdigest() for b, n in zip(ends.tolist(), counts.tolist())]
        of_bytes = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [*keep, *DIGESTS])


def _mapped(df: DataFrame, run, added: dict[str, T.DataType]) -> DataFrame:
    fields = [f for f in df.schema if f.name not in added]
    return df.mapInArrow(run, T.StructType(fields + [T.StructField(n, t) for n, t in added.items()]))


IDS = T.ArrayType(T.IntegerType())
DIGESTS = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def encode(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """docs with `ids` (array<int>) and `slice_ends` (array<int>: where each pre-token ends, in bytes of the text)."""
    return _mapped(docs, lambda batches: encoding(batches, vocab_path, text), {"ids": IDS, "slice_ends": IDS})


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """The columns of `encoded` with `decoded` (binary): the bytes that `ids` stand for. Null ids: empty."""
    return _mapped(encoded, lambda batches: decoding(batches, vocab_path), {"decoded": T.BinaryType()})


def digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encode, decode and hash in one pass over the
    batches, so that a task needs one Python worker."""
    run = lambda batches: digesting(decoding(encoding(batches, vocab_path, "text"), vocab_path), ["doc_id"])
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in DIGESTS.items()]))


def round_trip(docs: DataFrame, vocab_path: str) -> DataFrame:
    """docs with n_tokens and ids, and `text` as decoded from the ids; columns with these names are replaced, all others kept."""
    others = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            kept = batch.select(others)
            own = iter([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int32()), batch.column(batch.num_columns - 1)], ["row", "text"])])
            for part in decoding(encoding(own, vocab_path, "text"), vocab_path):
                texts = part.column("decoded").cast(pa.string())  # whole texts are UTF-8 again
                ids = part.column("ids")
                rows = kept.slice(part.column("row")[0].as_py(), part.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, texts, ids.value_lengths().cast(pa.int64()), ids], [*others, "text", "n_tokens", "ids"])

    added = [T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", IDS)]
    return docs.select(*others, "text").mapInArrow(run, T.StructType([docs.schema[c] for c in others] + added))
