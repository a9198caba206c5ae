"""Quality rules with risk-controlled thresholds.

DataFrame functions only. Each text is counted once: words, symbols, repeated lines, words in repeated 8-word windows.
Four rates follow, each larger the worse a text looks. For each stratum of text lengths and each rate, the labelled good
documents give, at every cutoff of a fixed grid, how many good ones it would reject; an exact binomial tail says whether
the true share of false rejections is proven to be at most ALPHA / 4. The smallest proven cutoff is used, and none where
nothing is proven. A trial is a document id: repeated rows of a labelled document count once, and of an id's different
texts the one with the smallest stratum and rates. With the level DELTA shared among all strata and rates (Bonferroni) and the ALPHA shared among the
rates of a stratum, all strata together hold: with probability 1 - DELTA, no stratum loses more than ALPHA of its good
documents to the rates. The tail grows as the cutoff falls, so testing the cutoffs from the largest down needs no
further correction.

Null and empty texts have no words and fail the base rule. Labels count once per id (good if any row says so); null
labels and ids without a document count nothing; without labels no cutoff is proven and only the base rule rejects.
Repeated rows give repeated rows; other columns aren't read; empty tables give empty results.
Windows and lines are compared by their text's 64-bit hash and by their text, respectively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.staging import staged

ALPHA, DELTA = 0.05, 0.1
#: Lower ends of the strata, in words; shorter texts fail the base rule.
STRATA = (20, 100, 500, 2000)
RATES = ("symbols", "dup_lines", "repeats", "bangs")
GRID = 100
TERMS = 2000
WHITE = " \t\n\x0b\x0c\r"


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_bangs and n_repeat_words of each text."""
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    bare = F.btrim("__t", F.lit(WHITE))
    df = df.withColumn("__w", F.when(bare != "", F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("__t", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    df = df.withColumns({"__n": F.size("__w"), "__lines": lines, "__h": F.transform("__w", lambda w: F.xxhash64(w))})
    # Hashes of two, four and eight words in a row, each from two of the size before.
    for size, before in ((2, "__h"), (4, "__h2"), (8, "__h4")):
        n = F.greatest(F.col("__n") - size + 1, F.lit(0))
        pair = F.zip_with(F.slice(before, F.lit(1), n), F.slice(before, F.lit(size // 2 + 1), n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(f"__h{size}", pair)
    df = df.withColumn("__again", F.size(F.array_distinct("__h8")) < F.size("__h8"))
    ordered = F.sort_array(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.col("__again"), ordered))
    like = lambda a, b: F.coalesce(F.get("__s", a)["h"] == F.get("__s", b)["h"], F.lit(False))
    places = F.filter(F.transform("__s", lambda x, k: F.when(like(k, k - 1) | like(k, k + 1), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("__p", F.when(F.col("__again"), F.sort_array(places)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("__p", start, lambda a, p: F.struct((p + 8).alias("end"), (a["n"] + p + 8 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return df.select(
        *keep, F.col("__n").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.regexp_count("__t", F.lit("!")).cast("long").alias("n_bangs"),
        F.when(F.col("__again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def stratum() -> Column:
    """The index of the text's stratum, by its number of words; null below all."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, F.lit(i)).otherwise(out)
    return out


def rates() -> dict[str, Column]:
    """Each rate in percent, rounded up; more than GRID counts as GRID + 1."""
    percent = lambda x, y: F.least(F.ceil(F.col(x) * 100 / F.greatest(F.col(y), F.lit(1))), F.lit(GRID + 1)).cast("int")
    return {"symbols": percent("n_symbols", "n_words"), "dup_lines": percent("n_dup_lines", "n_lines"), "repeats": percent("n_repeat_words", "n_words"), "bangs": percent("n_bangs", "n_words")}


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, stepped down."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        series = series - F.log(x + i)
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) from its TERMS largest terms; 1 if k >= n p. Exact for k < TERMS; for larger k the terms left out
    are bounded by a geometric series, so the value is never too small, and a cutoff that it proves is proven."""
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))

    def step(a, i):
        ratio = (k - i) / (n - k + i + 1) * ((1 - p) / p)
        return F.struct((a["term"] * ratio).alias("term"), (a["sum"] + a["term"]).alias("sum"))

    last = F.least(k, F.lit(TERMS - 1.0))
    ratio = (k - last) / (n - k + last + 1) * ((1 - p) / p)
    total = F.aggregate(F.sequence(F.lit(0), last.cast("int")), start, step, lambda a: a["sum"] + a["term"] / (1 - ratio))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """For each stratum and rate, how many good documents it has, and the smallest proven cutoff (null: none)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    columns = rates()
    trials = counted.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(stratum().alias("stratum"), *(columns[r].alias(r) for r in RATES))).alias("t"))
    each = trials.select("t.stratum", F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), F.col(f"t.{r}").alias("value")) for r in RATES))).alias("x"))
    values = each.where("stratum is not null").groupBy("stratum", "x.rate", "x.value").count()
    by_rate = values.groupBy("stratum", "rate").agg(F.sum("count").alias("n"), F.collect_list(F.struct("value", "count")).alias("values"))  # GRID + 2 entries at most
    rejected = lambda c: F.aggregate(F.filter("values", lambda v: v["value"] > c), F.lit(0).cast("long"), lambda a, v: a + v["count"])
    tested = by_rate.select("stratum", "rate", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda c: F.struct(c.alias("c"), rejected(c).alias("k")))).alias("t"))
    tail = binomial_tail(F.col("n"), F.col("t.k"), alpha / len(RATES))
    return tested.withColumn("tail", tail).groupBy("stratum", "rate").agg(F.max("n").alias("n_good"), F.min(F.when(F.col("tail") <= delta / (len(RATES) * len(STRATA)), F.col("t.c"))).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = staged(counts(docs))
    by_stratum = cutoffs(counted, labels).groupBy("stratum").agg(*(F.max(F.when(F.col("rate") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RATES))
    columns = rates()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    bad = F.lit(False)
    for r in RATES:
        bad = bad | F.coalesce(columns[r] > F.col(f"cut_{r}"), F.lit(False))
    joined = counted.withColumn("stratum", stratum()).join(F.broadcast(by_stratum), "stratum", "left")  # a row for each of STRATA
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~bad).alias("kept"))


def _oracle() -> str:
    p, level = ALPHA / len(RATES), DELTA / (len(RATES) * len(STRATA))
    strata = "CASE " + " ".join(f"WHEN n_words >= {low} THEN {i}" for i, low in reversed(list(enumerate(STRATA)))) + " END"
    percent = lambda x, y: f"least(ceil({x} * 100 / greatest({y}, 1)), {GRID + 1})::INT"
    values = {"symbols": percent("n_symbols", "n_words"), "dup_lines": percent("n_dup_lines", "n_lines"), "repeats": percent("n_repeat_words", "n_words"), "bangs": percent("n_bangs", "n_words")}
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p}))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM d),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w))),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE c > 1) GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again USING (r)),
s AS (SELECT *, {strata} AS stratum, {', '.join(f'{v} AS v_{r}' for r, v in values.items())} FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
v AS (SELECT stratum, unnest([{', '.join(f"'{r}'" for r in RATES)}]) AS rate, unnest([{', '.join(f'v_{r}' for r in RATES)}]) AS value FROM (
  SELECT * FROM s WHERE doc_id IN (FROM good) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY stratum NULLS FIRST, {', '.join(f'v_{r}' for r in RATES)}) = 1) WHERE stratum IS NOT NULL),
k AS (SELECT stratum, rate, c, count(*) AS n, count(*) FILTER (value > c) AS k FROM v, range({GRID + 1}) AS g(c) GROUP BY ALL),
q AS (SELECT stratum, rate, c, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: {term})) END AS tail FROM k),
cut AS (SELECT stratum, {', '.join(f"min(c) FILTER (rate = '{r}' AND tail <= {level}) AS c_{r}" for r in RATES)} FROM q GROUP BY stratum),
j AS (SELECT s.*, cut.* EXCLUDE (stratum), (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s LEFT JOIN cut ON s.stratum = cut.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f'coalesce(v_{r} > c_{r}, false)' for r in RATES)}) AS kept FROM j"""


ORACLE_SQL = _oracle()
