"""Language identification by cross-parsing.

A suffix automaton of labelled text per language gives the longest match of that text from any place of a document. A
document is parsed greedily into longest matches; the language whose text needs the fewest phrases, each weighing the
logarithm of that text's length and all divided by the document's length, wins. It is one parse of the whole text. Work
is dealt out in stretches of STRETCH symbols, all stretches of a block in lockstep, so that a step is one numpy gather for
each language: a stretch is first parsed from the automaton's start, then again from where the stretch before it ended, up to
the step at which both parses meet in one state (from there on they are the same), until no stretch begins anew.

Symbols are lower-case letters, the commonest beyond a-z with symbols of their own, and one blank for whatever stands
between letters; a symbol that a language's text lacks is a phrase. The labelled text is a bounded sample: at most SYMBOLS
symbols over all languages and MOST for one, in pieces of SAMPLE code points drawn by hash from all places of all
labelled texts (equal pieces once). Texts without letters, null texts and, without labelled text, all texts get `und` with
score 0; ties go to the language that sorts first. A prediction depends on the text alone, so repeated rows, ids, sources
and extra columns make no difference.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.blocks import text_blocks
from docengine.llm.labelled import remainder

SYMBOLS, MOST = 400_000, 40_000
SAMPLE = 400
OWN = 20
ALPHABET, BLANK, REST, PAD = 64, 0, 27 + OWN, 63
STRETCH, CHECK = 256, 32
TEMPERATURE = 0.02
BLOCK = 1_000_000


@lru_cache(maxsize=4)
def symbol_table(letters: str) -> np.ndarray:
    """The symbol of each code point; `letters`: those beyond a-z that have their own."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] == "L":
            out[cp] = REST
    for c in "abcdefghijklmnopqrstuvwxyz":
        out[ord(c)] = out[ord(c.upper())] = ord(c) - 96
    for i, c in enumerate(letters):
        out[ord(c)] = 27 + i
        if len(c.upper()) == 1:
            out[ord(c.upper())] = 27 + i
    return out


def stream(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of blanks as one, and where each text begins (n + 1 entries)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), starts)
    symbols = table[points]
    kept = symbols != BLANK
    kept[1:] |= symbols[:-1] != BLANK
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    kept[first] = True
    at = np.flatnonzero(kept)
    return symbols[at], np.searchsorted(at, bounds)


def suffix_automaton(text: np.ndarray) -> np.ndarray:
    """Transitions [state * ALPHABET + symbol] of the automaton of all substrings, ready for greedy parsing: where no
    transition exists, ~t stands, with t the state after that symbol from the root. Behind a symbol that the text lacks
    comes a state with broken transitions only; PAD leads to one more state, which it keeps."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    n = len(follow)
    out = np.zeros((n + 2, ALPHABET), np.int32)
    sizes = np.array([len(f) for f in follow])
    rows = np.repeat(np.arange(n), sizes)
    out[rows, np.fromiter((c for f in follow for c in f), np.int64, sizes.sum())] = np.fromiter((t for f in follow for t in f.values()), np.int64, sizes.sum())
    begin = np.where(out[0, :PAD] == 0, n, out[0, :PAD])
    out[:, :PAD] = np.where(out[:, :PAD] == 0, ~begin, out[:, :PAD])
    out[0, :PAD] = begin
    out[:, PAD] = n + 1
    return out.reshape(-1)


@lru_cache(maxsize=512)
def _automaton(text: bytes) -> np.ndarray:
    return suffix_automaton(np.frombuffer(text, np.uint8))


def phrases(stretches: np.ndarray, before: np.ndarray, automaton: np.ndarray) -> np.ndarray:
    """How many greedy longest-match phrases each text has (0 for an empty one); stretches[k]: the k-th symbols of all
    stretches, PAD behind a text's end; text i has the stretches before[i] to before[i + 1]."""
    checks, n = len(stretches) // CHECK, stretches.shape[1]
    ends, breaks = np.zeros((checks, n), np.int32), np.zeros((checks, n), np.int32)

    def parse(which: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Parse these stretches from these states until they meet the parse known so far; those that end in a new state."""
        for k in range(checks):
            count = np.zeros(len(which), np.int32)
            for symbols in stretches[k * CHECK : (k + 1) * CHECK]:
                to = automaton.take(state * ALPHABET + (symbols if len(which) == n else symbols[which]))
                broken = to >> 31
                count -= broken
                state = to ^ broken
            new = state != ends[k, which]
            breaks[k, which] = count
            ends[k, which] = state
            which, state = which[new], state[new]
            if not len(which):
                break
        return which

    ends[:] = -1
    parse(np.arange(n), np.zeros(n, np.int32))
    first = np.zeros(n + 1, bool)
    first[before] = True
    again = np.flatnonzero(~first[:n])
    while len(again):
        changed = parse(again, ends[-1, again - 1]) + 1
        again = changed[~first[changed]]
    full = before[:-1] < before[1:]
    out = np.zeros(len(before) - 1, np.int64)
    if full.any():
        out[full] = 1 + np.add.reduceat(breaks.sum(0), before[:-1][full])
    return out


def stretches_of(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix that `phrases` reads, and how many stretches come before each text (n + 1 entries)."""
    counts = np.diff(first)
    each = -(-counts // STRETCH)
    before = np.concatenate([[0], np.cumsum(each)])
    out = np.full((before[-1], STRETCH), PAD, np.int32)
    place = np.arange(len(symbols)) - np.repeat(first[:-1], counts)
    out.reshape(-1)[np.repeat(before[:-1] * STRETCH, counts) + place] = symbols
    return np.ascontiguousarray(out.T), before


def training_texts(docs: DataFrame) -> tuple[str, dict[str, bytes]]:
    """The letters beyond a-z that get symbols, and each language's labelled text as symbols."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 4) != 2))
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.sum(F.length("text"))).collect()}  # a row for each language
    if not sizes:
        return "", {}
    share = min(MOST, max(1, SYMBOLS // len(sizes)))
    # Pieces are drawn with a chance that leaves some three times as much as is used; a piece's draw is its own.
    bar = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, 3 * (share + SAMPLE) / max(n, 1))))) for lang, n in sizes.items()))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(SAMPLE))
    drawn = F.filter(F.transform(starts, lambda at: F.struct(at.alias("at"), F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), at), F.lit(1 << 30)).alias("draw"))), lambda x: x["draw"] <= bar)
    pieces = labelled.select("lang", "text", F.explode(drawn).alias("x")).select("lang", F.substr("text", F.col("x.at"), F.lit(SAMPLE)).alias("piece"), "x.draw")
    pieces = pieces.groupBy("lang", "piece").agg(F.min("draw").alias("draw"))  # copies meet before the shuffle
    upto = F.sum(F.length("piece") + 1).over(W.partitionBy("lang").orderBy("draw", "piece").rowsBetween(W.unboundedPreceding, -1))
    used = pieces.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < share)
    rows = sorted(used.select("lang", "upto", "piece").collect())  # `share` code points and one piece for each language
    common = Counter(c for _, _, text in rows for c in text.lower() if ord(c) > 127 and c.isalpha())
    letters = "".join(c for c, _ in sorted(common.most_common(OWN), key=lambda x: (-x[1], x[0])))
    table, texts = symbol_table(letters), {}
    for lang, _, text in rows:
        if len(texts.get(lang, b"")) < share:
            raw = np.frombuffer(text.encode(), np.uint8)
            texts[lang] = (texts.get(lang, b"") + stream(raw, np.array([0, len(raw)]), table)[0].tobytes() + b"\0")[:share]
    return letters, {lang: t for lang, t in sorted(texts.items()) if t.strip(b"\0")}


def predict(docs: DataFrame, letters: str, texts: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score of every whole text. `texts`: SYMBOLS symbols at most; the workers build the automata."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [*texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, automata = symbol_table(letters), [_automaton(t) for t in texts.values()]
        weights = np.array([np.log2(max(len(t), 2)) for t in texts.values()])
        for block in text_blocks(batches, text, BLOCK):
            symbols, first = stream(block.data, block.starts, table)
            lettered = np.add.reduceat(np.append(symbols != BLANK, False), first[:-1]) * (first[:-1] < first[1:]) if block.n else np.zeros(0)
            known = (lettered > 0) & (len(names) > 0)
            labels, scores = np.full(block.n, "und", object), np.zeros(block.n)
            if known.any():
                matrix, before = stretches_of(symbols, first)
                bits = np.stack([phrases(matrix, before, automaton) * weight for automaton, weight in zip(automata, weights)])
                best = bits.argmin(0)
                odds = np.exp(-TEMPERATURE * np.minimum((bits - bits.min(0)), 1e4))
                labels[known] = np.array(names, object)[best[known]]
                scores[known] = (1 / odds.sum(0))[known]
            yield pa.RecordBatch.from_arrays([*block.batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores)], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned outside the fold crc32(doc_id) mod 4 = 2."""
    found = predict(docs.select("doc_id", "text"), *training_texts(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
