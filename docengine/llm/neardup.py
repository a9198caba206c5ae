"""Near-duplicate documents: circulant MinHash, banding, exact verification, connected components.

A document's set holds its distinct runs of SHINGLE words (A-Z lower-cased, words are anything but white space); with
fewer words the whole sequence is its one run. Documents with equal sets are one class, so copies cost one row each and
are never paired. Two permutations make a signature: the first scatters a run over D places, the second is a table whose
circular shifts by 0, 1, ... give all coordinates, so a run's values are one contiguous slice of the table, and the
signature is the minimum of a set's slices. BANDS groups of coordinates are hashed to buckets; two sets as similar as the
threshold miss each other in all bands with a probability below 1e-6.

Classes in one bucket are tied to its smallest one. What is tied together, over any bands, forms a cluster, and every
link lies within a cluster. Only then are the sets of clustered classes computed again. First each class is compared with
one class that it is tied to, a star of any size being dealt out over many tasks; this joins a group of close copies in
linear time, and a cluster that it joins whole is done. The sets of other clusters are cut into pieces of about PIECE runs
and MEMBERS classes, those of the largest connected part apart from the others; each pair of pieces, but for two of that
part, is joined exactly by a prefix-filtered set-similarity join over full sets, which passes over what is connected already
and returns a spanning forest of the links that it finds. So no pairs of a group are
emitted, no group need fit into one task, and no link between different texts is lost. Components of the links follow.

Null and empty texts, and texts without words, have empty sets, which are linked with nothing. A null id can't be linked:
its component is null and it is kept. Rows with one id are one node, whatever their texts: what any of them is linked with
is linked with all. Ties: the smallest id stands for its component. Runs are compared by 64-bit hashes. Empty tables give
empty results. The steps' tables are deleted once the components are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.llm.blocks import LOWER, SPACE, mix64, shingle_hashes, slice_hashes, text_blocks, word_bounds
from docengine.llm.graph import components
from docengine.llm.staging import kept, scratch, staged

SHINGLE = 5
BANDS = 48
PLACES = 1 << 20
PIECE = 400_000
MEMBERS = 256
BITS = 1 << 28  # of the filter of clustered ids, at most: 32 MB
PAGE = 1 << 18  # bits of the filter that one task makes and the driver fetches as one value
HOT = 50_000  # classes of a bucket from which it is told to all tasks, for HOT_BUCKETS buckets at most
HOT_BUCKETS = 10_000


def rows_per_band(percent: int) -> int:
    """Coordinates of a band, so that sets of that similarity are missed with a probability below 1e-6."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** BANDS < 1e-6:
        rows += 1
    return rows


@lru_cache(maxsize=2)
def shifted(coordinates: int) -> np.ndarray:
    """Row s holds the second permutation's values at s, s + 1, ... (circularly): what a run at place s contributes."""
    table = np.random.default_rng(20260101).permutation(PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:coordinates]]), coordinates)


def signature(runs: np.ndarray, coordinates: int) -> np.ndarray:
    values = shifted(coordinates)
    places = (mix64(runs + np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(44)).astype(np.intp)  # the first permutation
    out = values[places[:2048]].min(0)
    for k in range(2048, len(places), 2048):
        np.minimum(out, values[places[k : k + 2048]].min(0), out=out)
    return out


def sets_of(block) -> list[np.ndarray]:
    """The sorted distinct runs of each text of a block."""
    low = LOWER[block.data]
    begin, end, words = word_bounds(low, block.starts, ~SPACE)
    hashes, before = shingle_hashes(slice_hashes(low, begin, end), words, SHINGLE)
    return [np.unique(hashes[a:b]) for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def sketches(docs: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set) and bands (a hash of each band; none for empty sets)."""
    rows = rows_per_band(percent)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_shingles", T.LongType()), ("set_id", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for block in text_blocks(batches, text):
            sets = sets_of(block)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(full), BANDS), np.uint64)
            if full:
                signed = np.stack([signature(sets[i], rows * BANDS) for i in full]).astype(np.uint64).reshape(len(full), BANDS, rows)
                for k in range(rows):
                    bands = mix64(bands + signed[:, :, k] + salt)
            counts = np.array([len(s) for s in sets])
            offsets = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(counts), pa.array(digests, pa.binary()), lists], schema.names)

    return docs.select("doc_id", text).mapInArrow(run, schema)


def join_sets(ids: list, sides: np.ndarray, sets: list[np.ndarray], percent: int, labels: list) -> list[tuple]:
    """A spanning forest of all links between sets of different sides (or all, if there is one side), as pairs of ids.
    Sets with one label count as connected.

    Runs are ordered by rarity within the group. Two linked sets share a run of their prefixes (the rarest runs, one more
    than the larger may lack), and their sizes differ little; sets that are connected already aren't compared again.
    """
    sizes = np.array([len(s) for s in sets])
    known, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, counts))] = np.arange(len(known))
    ranks = rank[inverse]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parts = [np.sort(ranks[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    common = counts[np.argsort(rank)] > 1
    heads: dict = {}
    root = [heads.setdefault(label, i) for i, label in enumerate(labels)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    single, mark, index, links = len(set(sides.tolist())) == 1, np.zeros(len(known), bool), {}, []
    for i in np.lexsort((np.arange(len(ids)), sizes)).tolist():
        own, n = parts[i], int(sizes[i])
        prefix = own[: n - -(-percent * n // 100) + 1]
        prefix = prefix[common[prefix]].tolist()
        met = set()
        for token in prefix:
            met.update(index.get(token, ()))
        mine = find(i)
        some = [j for j in met if 100 * sizes[j] >= percent * n and (single or sides[j] != sides[i]) and find(j) != mine]
        if some:
            mark[own] = True
            some.sort()
            inside = np.add.reduceat(mark[np.concatenate([parts[j] for j in some])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            mark[own] = False
            for j in np.array(some)[100 * inside >= percent * (n + sizes[some] - inside)].tolist():
                if (theirs := find(j)) != (mine := find(i)):
                    root[theirs] = mine
                    links.append((ids[i], ids[j]))
        for token in prefix:
            index.setdefault(token, []).append(i)
    return links


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids: any id of `ids` (doc_id) passes, most others don't. Its size is bounded by BITS, whatever
    the number of ids; tasks make pages of it, and the driver puts these together. A fuller one passes more (from some BITS / 16
    ids on, a good part of all; from BITS on, almost everything), and what passes still meets an exact join."""
    bits = min(BITS, 1 << max(16, (16 * ids.count()).bit_length()))
    size = min(PAGE, bits)

    def page(group: pa.Table) -> pa.Table:
        on = np.zeros(size, np.uint8)
        on[group.column("p").to_numpy() % size] = 1
        return pa.table({"page": pa.array([group.column("p")[0].as_py() // size], pa.int64()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    places = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")).distinct()
    out = np.zeros(bits // 8, np.uint8)
    for number, raw in places.groupBy(F.floor(F.col("p") / size)).applyInArrow(page, "page long, bits binary").collect():  # bits / 8 bytes
        out[number * (size // 8) : (number + 1) * (size // 8)] = np.frombuffer(raw, np.uint8)
    return out.view(np.uint32)


def passes(bitmap: np.ndarray, hashes: pa.Array) -> np.ndarray:
    place = hashes.to_numpy(zero_copy_only=False) % np.int64(32 * len(bitmap))
    return ((bitmap[place >> 5] >> (place & 31).astype(np.uint32)) & 1).astype(bool)


def tied(banded: DataFrame) -> DataFrame:
    """(a, b): each class of a bucket (rep, band, key) with the bucket's smallest one. Buckets of HOT classes and more meet
    theirs in a broadcast of HOT_BUCKETS rows at most, the largest first, so none is one task's."""
    buckets = staged(banded.groupBy("band", "key").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1"))
    hot = buckets.where(F.col("size") >= HOT).orderBy(F.desc("size"), "band", "key").limit(HOT_BUCKETS).select("band", "key", "first")
    hot = staged(hot)
    pair = lambda df: df.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    if hot.isEmpty():
        return pair(banded.join(buckets, ["band", "key"]))
    told = banded.join(F.broadcast(hot), ["band", "key"], "left")
    rest = told.where("first is null").drop("first").join(buckets.join(F.broadcast(hot), ["band", "key"], "left_anti"), ["band", "key"])
    return pair(told.where("first is not null")).unionAll(pair(rest))


def components_of(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component of every row of docs; links: 100 * intersection >= percent * union."""
    with scratch(docs.sparkSession):
        return kept(_components_of(docs, percent, text))


def _components_of(docs: DataFrame, percent: int, text: str) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    rows = staged(sketches(docs, percent, text))
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = staged(linkable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")))
    banded = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    ties = staged(tied(banded).distinct())
    clusters = components(ties)
    members = staged(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    # Only rows whose id is clustered need their sets again.
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(members.select("doc_id")))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("runs", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks([batch.filter(pa.array(passes(shared.value, batch.column(1))))], text):
                yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array([s.tobytes() for s in sets_of(block)], pa.binary())], schema.names)

    sets = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"), text).mapInArrow(gather, schema)
    sets = staged(sets.join(members, "doc_id").where("length(runs) > 0"))

    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_pylist()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("runs").combine_chunks()] if len(ids) > 1 else []
        links = join_sets(ids, group.column("side").to_numpy(), found, percent, group.column("label").to_pylist()) if found else []
        kind = group.schema.field("doc_id").type
        return pa.table({"a": pa.array([x[0] for x in links], kind), "b": pa.array([x[1] for x in links], kind)})

    link_schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    # A join's partitioning by one column would keep all lots or pieces in one task; hence the repartitioning by all of them.
    # Stars: side 1 has the classes tied to a pivot, dealt out in lots; side 0 has the pivot in each lot.
    stars = staged(ties.groupBy("a").agg(F.min("b").alias("pivot")))
    lots = stars.groupBy("pivot").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("lots"))
    rays = stars.join(lots, "pivot").select(F.col("a").alias("doc_id"), "pivot", F.pmod(F.hash("a"), F.col("lots")).alias("lot"))
    rays = sets.join(rays, "doc_id").select("pivot", "lot", "doc_id", "runs", F.lit(1).alias("side"), F.col("doc_id").alias("label"))
    pivots = sets.join(lots, F.col("doc_id") == F.col("pivot")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "doc_id", "runs", F.lit(0).alias("side"), F.col("doc_id").alias("label"))
    near = staged(rays.unionAll(pivots).repartition("pivot", "lot").groupBy("pivot", "lot").applyInArrow(verify, link_schema))
    joined = components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    labelled = sets.join(joined, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    # Clusters that the stars have not joined whole. What has a cluster's commonest label is connected, so its `inner` pieces
    # meet only the `outer` ones of all other labels, never each other.
    need = lambda n, size: F.greatest(F.ceil(size / (8 * PIECE)), F.ceil(n / MEMBERS)).cast("int")
    per = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum(F.length("runs")).alias("size"))
    left = per.groupBy("cluster").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1")
    split = need(F.col("n"), F.col("size")) > 1
    left = left.select("cluster", F.col("top.label").alias("main"), F.when(split, need(F.col("top.n"), F.col("top.size"))).otherwise(0).alias("inner"), F.when(split, need(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size"))).otherwise(1).alias("outer"))
    place, is_main = F.hash("doc_id", F.lit("piece")), (F.col("inner") > 0) & (F.col("label") == F.col("main"))
    cut = labelled.join(left, "cluster").withColumn("side", F.when(is_main, F.pmod(place, F.greatest("inner", F.lit(1)))).otherwise(F.col("inner") + F.pmod(place, F.col("outer"))))
    others = F.sequence(F.when(is_main, F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)
    paired = cut.select("cluster", "doc_id", "runs", "side", "label", F.explode(others).alias("other"))
    paired = paired.withColumns({"piece": F.least("side", "other"), "with": F.greatest("side", "other")})
    links = near.unionAll(paired.repartition("cluster", "piece", "with").groupBy("cluster", "piece", "with").applyInArrow(verify, link_schema))
    # An id with texts of several classes links these.
    several = linkable.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low <> high").select("doc_id")
    own = linkable.select("doc_id", "set_id").join(several, "doc_id", "left_semi").distinct().join(classes.select("set_id", "rep"), "set_id")
    linked = components(links.unionAll(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    labels = classes.select("set_id", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    return rows.join(labels, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def report(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document stands for its component)."""
    found = components_of(docs.select("doc_id", "text"), percent)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, of one document of each component: the one with the smallest id. Further rows with
    that id stay as well."""
    found = components_of(docs.select("doc_id", text), percent, text)
    dropped = staged(found.where("doc_id <> component").select("doc_id").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(dropped))

    def rows(hit: bool) -> DataFrame:
        """The rows that the bitmap of dropped ids passes, or all others; only the former need a join, with their texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                passed = passes(shared.value, batch.column(batch.num_columns - 1))
                kept = batch.filter(pa.array(passed == hit))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], batch.schema.names[:-1])

        return docs.select("*", F.xxhash64("doc_id")).mapInArrow(run, docs.schema)

    return rows(False).unionAll(rows(True).join(dropped, "doc_id", "left_anti").select(docs.columns))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
l AS (SELECT na.doc_id AS a, nb.doc_id AS b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)),
reach(node, low) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT e.b, reach.low FROM reach JOIN e ON e.a = reach.node WHERE reach.low < e.b),
c AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(d.doc_id = c.component_id, true) AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN c ON c.node = d.doc_id"""
