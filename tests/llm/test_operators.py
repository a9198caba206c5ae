"""Each operator against brute force, SQL, a reference library or held-out labels, on small tables."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docengine.llm import bpe, decontamination, graph, langid, licenses, lm, neardup, pii, quality, queries, rules, toxicity
from tests.conftest import same_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def shingles(w, n=5):
    return [tuple(w)] * bool(w) if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, sf_dir, duck, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- bpe ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path(queries.BPE_RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    raw = [t.encode() for t in texts]
    ids, counts, ends, n = bpe.encode_block(bpe.vocabulary(public_tokenizers.path(queries.BPE_RANKS)), np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])], [x.tolist() for x in np.split(ends, np.cumsum(n)[:-1])]


def test_bpe_equals_the_library(tiktoken_encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for alphabet in ("ab st're ve ll'd  \n\t'''s!?.. 12٣é漢🙂 　'\x1c\x85_", "'sreveldtm x\n") for _ in range(3000)]
    texts += ["", "a" * 5000, " " * 3000, "é" * 4000 + "x" * 3000, "ab" * 4000, "\n\n", "it's", " 's", "'s's"]
    ids, ends = encoded(texts)
    for text, own, stops in zip(texts, ids, ends):
        assert own == tiktoken_encoding.encode_ordinary(text)
        assert (stops[-1] if stops else 0) == len(text.encode())


def test_bpe_digests(docs, tiktoken_encoding):
    got = {r.doc_id: r for r in bpe.digest(docs, public_tokenizers.path(queries.BPE_RANKS)).collect()}
    for r in docs.collect():
        ids = tiktoken_encoding.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_bpe_round_trip(docs):
    path = public_tokenizers.path(queries.BPE_RANKS)
    assert bpe.decode(bpe.encode(docs, path), path).where(F.col("decoded") != F.encode("text", "UTF-8")).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------------


def brute_leaks(rows, items):
    """(doc, item) -> (similarity, first word) of the best window, over all windows."""
    distinct = {tuple(w) for _, w in items if w}
    df = Counter(s for w in distinct for s in set(shingles(list(w))))
    weigh = lambda s: math.log1p(len(distinct) / df.get(s, 1))
    want = {}
    for doc, text in rows:
        w = words(text)
        runs = shingles(w)
        for item, own in items:
            n, mine = len(own), set(shingles(own))
            if not n or not w or n < 5 and n != len(w):
                continue
            width = max(1, min(n, len(w)) - 4)
            best = max((round(math.fsum(map(weigh, set(runs[a : a + width]) & mine)) / math.fsum(map(weigh, set(runs[a : a + width]) | mine)), 6), -a) for a in range(len(runs) - width + 1))
            if best[0] >= 0.8:
                want[doc, item] = (best[0], -best[1])
    return want


@pytest.mark.parametrize("slice_size", [2, 20_000])
def test_leaks_equal_brute_force(spark, monkeypatch, slice_size):
    monkeypatch.setattr(decontamination, "SLICE", slice_size)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (3, 5, 12, 20, 40, 41, 60)] + [["same"] * 12] + [text(2500)] + [[]]
    items.append(items[4])
    rows = []
    for k in range(60):
        w = text(rng.randint(0, 80))
        if k % 2:
            copy = list(rng.choice(items[:8]))
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if k % 5 == 0:  # an item alone, shortened
                w, copy = [], copy[rng.randrange(3) : len(copy) - rng.randrange(2)]
            at = rng.randint(0, len(w))
            w[at:at] = copy
        rows.append((k, " ".join(w)))
    whole = items[8]
    rows += [(100, " ".join(items[0])), (101, " ".join(["same"] * 40)), (102, " ".join(text(900) + whole[:2350] + text(700))), (103, " ".join(whole[:1200])), (104, " ".join(whole[20:]))]
    items = list(enumerate(items))
    want = brute_leaks(rows, items)
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == want
    assert len(want) > 15 and {(102, 8), (104, 8)} <= set(want) and (103, 8) not in want


def test_fingerprints_of_windows_equal_those_of_the_same_runs():
    rng = np.random.default_rng(4)
    runs = rng.integers(0, 40, 300).astype(np.uint64)
    weights = np.log1p(runs.astype(float) + 1)
    previous = decontamination.previous_places(runs)
    for width in (1, 7, 60, 300):
        starts = np.arange(0, 300 - width + 1, 3)
        got = decontamination.fingerprints(runs, weights, previous, width, starts)
        for s, row in zip(starts, got):
            own, at = np.unique(runs[s : s + width], return_index=True)
            alone = decontamination.fingerprints(own, weights[s:][at], np.full(len(own), -1), len(own), np.zeros(1, np.int64))
            assert (row == alone[0]).all()


def test_leaks_of_documents_shorter_than_the_item(spark):
    item = [f"w{i}" for i in range(37)]
    rows = [(1, " ".join(item[:-2])), (2, " ".join(item[3:])), (3, " ".join(item[:-7])), (4, " ".join(item[:4])), (5, " ".join(item[:-1] + ["other"] * 3))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (10, "a b c d e f g")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(1, 9): (0, 35, round(31 / 33, 6)), (2, 9): (0, 34, round(30 / 33, 6)), (5, 9): (0, 37, round(32 / 34, 6))}
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [3, 4]


def test_leaks_do_not_depend_on_slices_and_copies(spark, monkeypatch):
    words_ = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    head = words_(99, 12)
    texts = [head + words_(k, 25) for k in range(6)]  # the texts share some runs
    near = texts[0][:-1] + ["other"]
    late = texts[4][:-2] + ["other"]
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(late))], "doc_id long, text string")
    plain = [(i, " ".join(t)) for i, t in enumerate(texts)]
    copies = plain + [(100 + i, ("  ".join(texts[0])).upper()) for i in range(30)]

    def found(items):
        rows = decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        return {(r.doc_id, r.item_id): (r.first_word, r.similarity) for r in rows}

    want, many = found(plain), found(copies)
    assert want.keys() == {(1, 0), (2, 4)}
    assert many == want | {(1, 100 + i): want[1, 0] for i in range(30)}
    monkeypatch.setattr(decontamination, "SLICE", 4)
    assert found(plain) == want and found(copies) == many


def test_leak_of_an_item_with_many_copies(spark):
    item = [f"w{i}" for i in range(57)]
    doc = item[:20] + ["other"] + item[21:]
    items = [(i, " ".join(item)) for i in range(20)] + [(100 + k, " ".join(f"v{k}x{i}" for i in range(9))) for k in range(40)]
    got = decontamination.leaks(spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.item_id, r.similarity) for r in got} == {(i, round(48 / 58, 6)) for i in range(20)}


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    items = decontamination.load_items([(i, " ".join(f"a{i}b{j}" for j in range(12 + i % 2))) for i in range(50)]).build()
    bits = np.unpackbits(items.prints[rng.integers(0, 50, 200)].view(np.uint8).reshape(200, -1), axis=1)
    for row in bits:
        row[rng.choice(128, rng.integers(0, 40), replace=False)] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint64).reshape(-1, 2)
    w, c = items.near(prints, np.full(200, 12), np.full(200, 12))
    distance = np.bitwise_count(prints[:, None] ^ items.prints[None]).sum(2)
    near = (distance <= decontamination.RADIUS) & (items.sizes == 12)
    assert set(zip(w.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near)))) and near.sum() > 60
    assert decontamination.RADIUS < decontamination.BLOCKS * (decontamination.ITEM_FLIPS + decontamination.WINDOW_FLIPS + 1)


# --- near duplicates ---------------------------------------------------------------------------------------------------


def brute_components(rows, percent):
    sets = {i: set(shingles(words(t))) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 4)  # so that clusters are cut into pieces
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, last = [], None
    for k in range(260):
        if last is None or k % 40 == 0:
            last = [rng.choice(vocabulary) for _ in range(rng.choice((6, 60, 120)))]
        w = list(last)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if k % 3 == 0:
            last = w  # a family drifts
        rows.append((k, " ".join(w) if k % 50 else ""))
    got = neardup.components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component) for r in got} == brute_components(rows, percent)


def test_one_id_with_several_texts_is_one_node(spark, duck):
    import duckdb

    a, b, c = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (7, "x y"), (8, "x y"), (4, c + " more"), (6, "alone"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.report(df).collect())
    want = {5: 3, 3: 3, 9: 3, 7: 4, 8: 4, 4: 4, 6: 6}
    assert got == sorted((i, len(set(shingles(words(t)))), want[i], want[i] == i) for i, t in rows)
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.register("documents", documents)
    assert sorted(con.execute(neardup.ORACLE_SQL).fetchall()) == got


def test_hot_buckets_give_the_same_ties(spark, monkeypatch):
    banded = spark.createDataFrame([(r, k % 3, r // (10 ** (k % 3))) for r in range(60) for k in range(3)], "rep long, band int, key long")
    plain = sorted(map(tuple, neardup.tied(banded).collect()))
    monkeypatch.setattr(neardup, "HOT", 5)
    assert sorted(map(tuple, neardup.tied(banded).collect())) == plain and len(plain) > 50
    monkeypatch.setattr(neardup, "HOT_BUCKETS", 1)
    assert sorted(map(tuple, neardup.tied(banded).collect())) == plain


def test_filter_passes_all_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAGE", 1 << 12)
    ids = spark.range(0, 9000, 3).select(F.col("id").alias("doc_id"))
    bitmap = neardup.id_filter(ids)
    hashes = spark.range(9000).select(F.xxhash64("id").alias("h")).toArrow().column("h").combine_chunks()
    passed = neardup.passes(bitmap, hashes)
    assert passed[::3].all() and passed.mean() < 0.5


def test_circulant_signatures_miss_few_links():
    rng = np.random.default_rng(11)
    rows = neardup.rows_per_band(85)
    missed = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 100).astype(np.uint64)
        b = np.concatenate([a[:92], rng.integers(0, 1 << 62, 8).astype(np.uint64)])  # similarity 92 / 108
        x, y = (neardup.signature(s, rows * neardup.BANDS).reshape(neardup.BANDS, rows) for s in (a, b))
        missed += not (x == y).all(1).any()
    assert missed == 0


def test_graph_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(35)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(root)}
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_signature_is_circulant():
    runs = np.arange(1, 50, dtype=np.uint64)
    table = neardup.shifted(16)
    assert (table[5, :-1] == table[5][:-1]).all() and (table[5, 1:] == table[6, :-1]).all()
    assert (neardup.signature(runs, 16) == np.minimum.reduce([neardup.signature(runs[k : k + 1], 16) for k in range(49)])).all()


# --- language model ----------------------------------------------------------------------------------------------------


def test_lm_base_equals_brute_force(docs):
    got = {r.doc_id: r for r in lm.report(docs, public_tokenizers.path(queries.PIECES)).collect()}
    tokens = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    c = Counter(w for i, t in tokens.items() if crc(i, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)


def test_lm_head_and_tail_agree(docs, monkeypatch):
    path = public_tokenizers.path(queries.PIECES)
    whole = {r.doc_id: (r.score, r.mixed) for r in lm.report(docs, path).collect()}
    monkeypatch.setattr(lm, "HEAD", 50)
    split = {r.doc_id: (r.score, r.mixed) for r in lm.report(docs, path).collect()}
    assert all(split[i] == pytest.approx(s, rel=1e-5) for i, s in whole.items())


def test_lm_score_equals_brute_force(spark):
    path = public_tokenizers.path(queries.PIECES)
    model = lm.pieces(path)
    texts = ["The Thing in éü", "", None, "漢x a  thing\n", "thing thing of aaaa", "zq", "x1 unseen wörd", "the end of the thing"]
    rows = [(i, t) for i, t in enumerate(texts)]
    train = [words(t) for i, t in rows if crc(i, 7) != 2]
    ends, inner = len(train), sum(map(len, train))
    count = Counter(w for t in train for w in t)
    known = min(0.98, max(0.02, 1 - sum(c == 1 for c in count.values()) / inner))

    def arc(b, first):
        h = lm.slice_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
        inside = math.exp(model.logs[model.table.get(h)][0])
        return math.exp(model.logs[model.table.get(h ^ lm.FIRST)][0]) + math.exp(model.mark) * inside if first else inside

    def lattice(word):
        b = word.encode()
        total = 0.0
        for cuts in product((0, 1), repeat=len(b) - 1):
            bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(b)]
            total += math.prod(arc(b[x:y], x == 0) for x, y in zip(bounds, bounds[1:]))
        return total

    go_on, stop = (inner + 1) / (inner + ends + 2), (ends + 1) / (inner + ends + 2)
    got = {r.doc_id: r for r in lm.report(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for i, t in rows:
        w = words(t)
        assert got[i].score == pytest.approx(sum(math.log10(lattice(x) * go_on) for x in w) + math.log10(stop), rel=1e-6)
        assert got[i].mixed == pytest.approx(sum(math.log10(((1 - known) * lattice(x) + known * count[x] / inner) * go_on) for x in w) + math.log10(stop), rel=1e-6)


def test_lattice_sums_all_segmentations():
    model = lm.pieces(public_tokenizers.path(queries.PIECES))

    def p(b, first):
        h = lm.slice_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))
        inner = model.logs[model.table.get(h)][0]
        return math.exp(np.logaddexp(model.logs[model.table.get(h ^ lm.FIRST)][0], model.mark + inner) if first else inner)

    for word in ("thing", "éü", "漢x", "aaaaaaa"):
        b = word.encode()
        total = 0.0
        for cuts in product((0, 1), repeat=len(b) - 1):
            bounds = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(b)]
            total += math.prod(p(b[x:y], x == 0) for x, y in zip(bounds, bounds[1:]))
        got = model.words(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]
        assert got == pytest.approx(math.log(total), rel=1e-9)
    long = ("ab" * 40).encode()
    data = np.frombuffer(long, np.uint8)
    assert model._long_word(lm.Slices(data), 0, 40) == pytest.approx(model.words(data, np.array([0]), np.array([40]))[0], rel=1e-9)


# --- classifiers -------------------------------------------------------------------------------------------------------


def area(scores, y):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    n1 = sum(y)
    return (ranks[np.array(y) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, module, label, least):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = module.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels, label)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert area([r.score for r in rows], [r[label] for r in rows]) >= least


def test_kernel_machine_tolerates_insertions(spark):
    rng = random.Random(1)
    vowels, consonants = "aeiou", "bcdfghklmnprstvw"
    word = lambda: "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    text = lambda: [word() for _ in range(rng.randint(10, 60))]
    rows, marks = [], []
    for i in range(900):
        w = text()
        if i % 6 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(("grumblequark", "zyxwobbler", "jinxquiffy")))
        rows.append((i, " ".join(w)))
        marks.append((i, int(i % 6 == 0)))
    hidden = ["g.r.u.m.b.l.e.q.u.a.r.k", "zy-xwob-bler", "j*inx*quiffy", "ZYXWOBBLER"]
    for k, h in enumerate(hidden):
        w = text()
        w[3:3] = [h, h]
        rows.append((10_000 + k, " ".join(w)))
    model = toxicity.fit(spark.createDataFrame(rows[:900], "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[10_000 + k] >= 0.5 for k in range(len(hidden)))
    assert sum(got[i] >= 0.5 for i, m in marks if not m) <= 15 and sum(got[i] >= 0.5 for i, m in marks if m) >= 135


def test_kernel_equals_brute_force():
    from itertools import combinations

    rng = np.random.default_rng(8)
    pieces, rarity = rng.integers(0, 5, (12, toxicity.PIECE)).astype(np.uint8), rng.random(toxicity.SIZE).astype(np.float32)

    def phi(piece):
        out = Counter()
        for a in range(toxicity.PIECE - toxicity.SPAN + 1):
            for rest in combinations(range(1, toxicity.SPAN), toxicity.ORDER - 1):
                key = 0
                for k in (0, *rest):
                    key = key * 32 + int(piece[a + k])
                out[key] += toxicity.DECAY ** (rest[-1] + 1 - toxicity.ORDER)
        return {k: v * float(rarity[k]) for k, v in out.items()}

    maps = [phi(p) for p in pieces]
    dot = lambda x, y: sum(v * y.get(k, 0.0) for k, v in x.items())
    got = toxicity.kernel(pieces, pieces[:5], rarity)
    for i, x in enumerate(maps):
        for j, y in enumerate(maps[:5]):
            assert got[i, j] == pytest.approx(dot(x, y) / math.sqrt(dot(y, y)), rel=1e-4)
    # The folded weights of a piece's subsequences sum to the machine's value on the Nystroem map.
    y = np.array([1.0] * 6 + [-1.0] * 6)
    weights = toxicity.train_machine(pieces, y, pieces[:5], rarity)
    gram = np.array([[dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) for b in maps[:5]] for a in maps[:5]])
    beta = np.linalg.lstsq(np.array([[dot(x, b) / math.sqrt(dot(b, b)) for b in maps[:5]] for x in maps]), [sum(v / float(rarity[k]) * weights[k] for k, v in x.items() if k) for x in maps], rcond=None)[0]
    assert np.linalg.matrix_rank(gram) == 5
    folded = [sum(b * dot(x, m) / math.sqrt(dot(m, m)) for b, m in zip(beta, maps[:5])) - sum(b * x.get(0, 0.0) * m.get(0, 0.0) / math.sqrt(dot(m, m)) for b, m in zip(beta, maps[:5])) for x in maps]
    direct = [sum(v / float(rarity[k]) * weights[k] for k, v in x.items() if k) for x in maps]
    assert np.corrcoef(folded, direct)[0, 1] > 0.99


def test_features_equal_brute_force():
    texts = ["The cat, the cat sat.", "", "A A a 12!!", "word"]
    raw = [t.encode() for t in texts]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    keys = np.sort(np.unique(quality.tokens(data, starts)[0]))[::2]
    vectors = np.random.default_rng(2).normal(size=(len(keys) + quality.SHAPES, quality.DIMENSION)).astype(np.float32)
    w = quality.DIMENSION + quality.CHANNELS
    model = quality.Model(keys, vectors, (), np.zeros(w), np.ones(w), 1.0)
    table = quality.KeyTable(keys, np.arange(len(keys)), -1)
    got = model.features(table, data, starts)
    for t, row in zip(texts, got):
        toks = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", t)
        if not toks:
            assert not row.any()
            continue
        shape = [4 if not x[0].isalnum() else 3 if x.isdigit() else 0 if x.islower() else 2 if x.isupper() and len(x) > 1 else 1 for x in toks]
        own = [quality.tokens(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)]))[0][0] for x in toks]
        at = {int(k): i for i, k in enumerate(keys)}
        ids = [at.get(int(k), len(keys) + s) for k, s in zip(own, shape)]
        assert np.allclose(row[: quality.DIMENSION], np.mean([vectors[i] for i in ids], 0), atol=1e-5)
        same = lambda k: sum(own[i] == own[i - k] for i in range(k, len(own))) / len(own)  # noqa: E731, B023
        assert np.allclose(row[quality.DIMENSION :], [same(1), same(2), np.mean([min(len(x), 40) / 10 for x in toks]), np.mean([i >= len(keys) for i in ids]), math.log1p(len(toks)) / 5], atol=1e-5)


def test_network_separates_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no linear machine can
    weights = quality.train_network(x, y)
    assert ((quality.logits(weights, x) > 0) == y).mean() > 0.9
    z = rng.normal(size=5000) * 2
    drawn = (rng.random(5000) < quality.sigmoid(z)).astype(float)
    assert quality.fit_temperature(3 * z, drawn) == pytest.approx(3, rel=0.15)


def test_classifiers_take_text_ids_and_repeated_ids(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(120):
        bad = i % 3 == 0
        rows.append((f"id-{i}", " ".join(rng.choice(("spam offer click now !!!" if bad else "a quiet plain sentence about rivers").split()) for _ in range(30))))
        marks.append((f"id-{i}", 3 if bad else 0, 2 if bad else 0))
    rows += [("id-5", "another text of the same id"), rows[7]]
    docs, labels = spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(marks, "doc_id string, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        once = {(r.doc_id, round(r.score, 12)) for r in module.classify(docs, labels, label).collect()}
        assert once == {(r.doc_id, round(r.score, 12)) for r in module.classify(docs.orderBy(F.rand(4)), labels, label).collect()}
        assert {i for i, _ in once} == {r[0] for r in rows}


def test_margins_do_not_depend_on_the_texts_around():
    def margins(texts, weights):
        raw = [t.encode() for t in texts]
        return toxicity.margins(*toxicity.stream(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)), weights)

    rng = np.random.default_rng(3)
    weights = rng.random(toxicity.SIZE).astype(np.float32)
    weights[0] = 0
    insult = np.zeros(toxicity.SIZE, np.float32)
    insult[toxicity.subsequence_ids(toxicity.stream(np.frombuffer(b"grumblequark", np.uint8), np.array([0, 12]))[0][:12], (0, 1, 2, 3))] = 1
    texts = ["a clean text", "grumblequark and more", "", "x", "  grumblequark", "\t", "one more", "grumblequark"]
    for w in (weights, -weights, rng.normal(size=toxicity.SIZE).astype(np.float32) * (weights > 0), insult):
        alone = np.concatenate([margins([t], w) for t in texts])
        for order in (np.arange(8), np.arange(8)[::-1], rng.permutation(8)):
            assert (margins([texts[i] for i in order], w) == alone[order]).all()
    assert margins(["a clean text", "grumblequark"], insult)[0, 0] == 0 < margins(["grumblequark"], insult)[0, 0]


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_phrases_equal_brute_force():
    rng = random.Random(4)
    text = np.array([rng.randrange(1, 4) for _ in range(300)], np.uint8)
    automaton = langid.suffix_automaton(text)
    t = text.tobytes()
    rows = [bytes(rng.randrange(1, 6) for _ in range(rng.randint(1, 60))) for _ in range(50)]

    def greedy(row):
        n, at = 0, 0
        while at < len(row):
            k = 1
            while at + k <= len(row) and row[at : at + k] in t:
                k += 1
            n, at = n + 1, at + max(k - 1, 1)
        return n

    # Texts of many stretches, among them one copied from the training text and ones that only meet it far on.
    rows += [b"", bytes(rng.randrange(1, 4) for _ in range(257)), bytes(rng.randrange(1, 4) for _ in range(5000)), t, t + t, b"\x01" * 700, t[:7] + t * 5 + b"\x05" * 300 + t, bytes(rng.choice((1, 2, 3, 3, 3, 9)) for _ in range(4000))]
    matrix, before = langid.stretches_of(np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    assert langid.phrases(matrix, before, automaton).tolist() == [greedy(row) for row in rows]
    pieces = [bytes([1 + i % 3]) * 2 for i in range(4000)]
    copied = np.frombuffer(b"".join(pieces), np.uint8)
    matrix, before = langid.stretches_of(copied, np.array([0, len(copied)]))
    assert langid.phrases(matrix, before, langid.suffix_automaton(copied)).tolist() == [1]


def test_language_sample_is_bounded_and_from_all_places(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST", 2000)
    rows = [(i, chr(97 + i % 26) * 3000 + chr(97 + (i + 1) % 26) * 3000, "aa") for i in range(26)] + [(100 + i, "x y", "bb") for i in range(50)] + [(i, "z" * 9000, "cc") for i in range(200, 230)] + [(300, None, "dd"), (301, "12", "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, texts = langid.training_texts(docs)
    assert set(texts) == {"aa", "bb", "cc"} and all(len(t) <= 2000 for t in texts.values())
    assert len(set(texts["aa"])) > 3 and len(texts["aa"]) > 1500 and texts["bb"].strip(b"\0") == bytes([24, 0, 25])


# --- rules, pii, licenses ----------------------------------------------------------------------------------------------


def test_binomial_tail(spark):
    cases = [(50, 0), (200, 3), (1000, 5), (60000, 500), (10**6, 9000)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.0125).alias("p"))
    for r in df.collect():
        log = lambda i: math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.0125) + (r.n - i) * math.log(0.9875)  # noqa: E731, B023
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.0125 else math.fsum(math.exp(log(i)) for i in range(r.k + 1)), rel=1e-6)


def test_binomial_tail_is_never_too_small(spark):
    cases = [(300_000, 3000), (400_000, 4900), (2_000_000, 24_700), (10**7, 124_000)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.0125).alias("p"))
    for r in df.collect():
        log = lambda i: math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.0125) + (r.n - i) * math.log(0.9875)  # noqa: E731, B023
        exact = math.fsum(math.exp(log(i)) for i in range(max(0, r.k - 20_000), r.k + 1))
        assert exact * (1 - 1e-6) <= r.p <= exact * 1.02


def test_repeated_labelled_rows_are_one_trial(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(30)) + ("!" * 9 if i < 12 else "")) for i in range(900)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    frame = lambda r: rules.counts(spark.createDataFrame(r, "doc_id long, text string"))
    read = lambda f: sorted(map(tuple, rules.cutoffs(f, labels).collect()), key=str)
    assert read(frame(rows)) == read(frame(rows + rows[20:] * 3)) == read(frame(rows + [(i, t + " x" * 40) for i, t in rows[:5]]))


def test_false_rejections_are_limited(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = rules.judge(docs, labels).join(labels, "doc_id").where("quality = 1 and not base_failed").selectExpr("avg(cast(not kept as double)) as share").first()
    assert out.share <= rules.ALPHA


def test_pii_kinds_and_checksums(spark):
    text = "😀 mail a.b@c.de; x@y (no) 1.2.3.4 and 300.1.1.1, card 4539 1488 0343 6467 or 4539148803436468, call +1 (555) 010-2030, IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001"
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = [s.split(":") for s in row.spans.split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (555) 010-2030"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    base = ",".join(":".join(s) for s in spans if s[0] != "iban")
    assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = pii.masked(spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, pii string")).orderBy("doc_id").collect()
    assert "a.b@c.de" not in clean[0].text and "<EMAIL>" in clean[0].text and "300.1.1.1" in clean[0].text and clean[1].text is None


def test_words_nearby_decide_on_added_spans(spark):
    iban, card = "DE89 3704 0044 0532 0130 00", "378282246310005"
    rows = [(1, f"to {iban} now"), (2, f"serial {iban}"), (3, f"serial {iban} of the bank"), (4, f"no. {card}"), (5, f"visa {card}"), (6, f"visa {card}, isbn")]
    got = {r.doc_id: r.spans.split(":")[0] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban", 2: "", 3: "iban", 4: "", 5: "card", 6: ""}


def test_ibans_before_capitals_and_digits(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"
    bare = de.replace(" ", "")
    cases = [(f"{bare} BIC COBADEFFXXX", [bare]), (f"{de} BIC: X", [de]), (f"pay {de} 2024 A", [de]), (f"{de} {gb}", [de, gb]), (f"{no} {bare} {gb} X", [no, bare, gb]), (f"AB12 {de} C", [de]), (f"{no},{gb}", [no, gb]), (f"{bare}X {de[:-1]}1 BIC", [])]
    rows = pii.report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    for r in rows:
        text, want = cases[r.doc_id]
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("iban")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == want, text
    masked = pii.masked(spark.createDataFrame([(1, f"to {de} BIC X")], "doc_id long, text string")).first().text
    assert masked == "to <IBAN> BIC X"


def test_pii_patterns_equal_the_plain_ones(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("a.@-+1 2(9)%_") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", *(F.regexp_extract_all("t", F.lit(pii.PATTERNS[k]), F.lit(0)).alias(k) for k in plain)).collect():
        for k, p in plain.items():
            assert r[k] == [m.group() for m in re.finditer(p, r.t)], (k, r.t)


def test_license_blocks(spark):
    gnu = "gnu of terms the under it modify or redistribute can you software free is this program license"  # all of a template but three words
    rows = [(1, "foo license MIT the\nunder"), (2, "x " * 100 + "License MIT the under released" + " y" * 100), (3, "MIT License, apache license; GENERAL public LICENSE mit license"), (4, "the under"), (5, "Licensed under CC BY-NC 3.0"), (6, f"words {gnu} words")]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "" and got[1].score == 0.0 and got[1].n_base == 0
    assert got[2].labels == "mit" and got[2].score == 1.0
    n = len(licenses.template_words(licenses.TEMPLATES[6][1]))
    assert (got[6].labels, got[6].score) == (("gpl", round((n - 3) / n, 6)) if n - 3 >= licenses.needed(n) else ("", 0.0))
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (4, 0, 7, "apache,gpl,mit")
    assert got[4].labels == "" and got[4].first_word is None
    assert got[5].labels == "cc-by-nc" and got[5].base_labels == "" and got[5].score == 1.0


def test_licenses_wrapped_over_lines(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for label, template in licenses.TEMPLATES:
        for width in (70, 75, 80, 24):
            lead = " ".join(rng.choice(("lorem", "ipsum", "dolor")) for _ in range(rng.randrange(90)))
            rows.append((k, textwrap.fill(f"{lead} {template} {lead}", width), label))
            k += 1
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    for i, _, label in rows:
        assert label in got[i].labels.split(",") and got[i].score == 1.0


def test_license_words_at_unicode_line_ends(spark):
    marks = ("\x85", "\u2028", "\u2029")
    rows = [(i, f"apache license {m}") for i, m in enumerate(marks)] + [(10 + i, f"foo mit license. {m}") for i, m in enumerate(marks)] + [(20, "..mit license..\n"), (21, "\n")]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOW))
        places = [k for k in range(len(w) - 1) if w[k + 1] == "license" and w[k] in ("mit", "apache")]
        assert (got[i].n_words, got[i].n_base, got[i].first_word) == (len(w), len(places), places[0] if places else None)
    assert got[0].n_words == 3 and got[10].n_words == 4
