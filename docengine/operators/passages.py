"""Source passages for evaluation: candidates within documents, a diverse sample of them, and question pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions.arrays import let
from docengine.functions.spans import containing, page_at
from docengine.functions.text import ANSWER_SENTENCE, alpha_ratio, counted, sentence_spans, stripped, uuid5
from docengine.operators.responses import answered, json_text

LEAST, MOST, TARGET, APART, PER_DOC = 150, 400, 250, 8, 3
# Beginnings of boilerplate, and phrases that point elsewhere.
BOILERPLATE = r"(?i)^\s*Footnote|^\s*Skip to|^\s*Search|^\s*Language selection|^\s*Return to footnote|^\s*Page \d+|^\s*Table of Contents|^\s*Item \d+[A-Z]?\s*$"
ELSEWHERE = r"(?i)\b(as discussed above|see above|the above|the foregoing|the table below|the figure below|the chart below|the previous|the preceding|see Note \d+|refer to page \d+)\b"
HINTS = ("above", "below", "the foregoing", "the previous", "the preceding", "see note", "refer to page")
OPENING = '"(['


def self_contained(text: Column) -> Column:
    """Fifty characters or more, opening like a sentence, not boilerplate, pointing nowhere else, half of it letters."""

    def tests(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        opens = first.rlike(r"^\p{Lu}") | F.contains(F.lit(OPENING), first)
        # Cheap tests go before the patterns: boilerplate shows at the beginning, and pointing phrases have one of few words.
        boilerplate = F.substring(t, 1, 40).rlike(BOILERPLATE) | (F.startswith(F.lower(F.substring(t, 1, 5)), F.lit("item ")) & t.rlike(BOILERPLATE))
        hinted = lambda low: F.coalesce(*(F.when(F.contains(low, F.lit(w)), True) for w in HINTS), F.lit(False))
        return (F.length(t) >= 50) & opens & ~boilerplate & ~(let(F.lower(t), hinted) & t.rlike(ELSEWHERE)) & (alpha_ratio(t) >= 0.5)

    return let(stripped(text), tests)


def candidates(docs: DataFrame, least: int = LEAST, most: int = MOST, target: int = TARGET, apart: int = APART) -> DataFrame:
    """(doc_id, doc_type, first_sentence, char_start, char_end, n_tokens, passage_text, section_title, section_number,
    page_number) of documents (doc_id, doc_type, full_text, sections, pages).

    From each sentence on, sentences are taken until they have `target` tokens. The window counts if its tokens lie in
    [least, most] and its text stands by itself; then, in order, a window is emitted if it begins `apart` sentences or more
    after the last emitted one and not within it. Windows come from running sums within the row, the choice from one fold.
    """
    df = docs.withColumn("__s", counted(sentence_spans(F.coalesce("full_text", F.lit("")), 0, ANSWER_SENTENCE)))
    df = df.where(F.size("__s") >= 4)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array(F.lit(0).cast("long")).alias("sums"))
    sums = F.aggregate(F.transform("__s", lambda s: s["n_tokens"]), start, lambda a, n: F.struct((a["total"] + n).alias("total"), F.concat(a["sums"], F.array(a["total"] + n)).alias("sums")), lambda a: a["sums"])
    df = df.withColumn("__sums", sums).withColumn("__n", F.size("__s"))

    def end_of(i: Column) -> Column:
        # The first end whose running sum reaches the target; the sums do not fall, so a binary search finds it.
        goal = F.get("__sums", i) + target
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("__n") + 1.0)).cast("int"))

        def halve(a: Column, _: Column) -> Column:
            middle = lambda m: F.when(F.get("__sums", m) >= goal, F.struct(a["lo"].alias("lo"), m.alias("hi"))).otherwise(F.struct((m + 1).alias("lo"), a["hi"].alias("hi")))
            return F.when(a["lo"] >= a["hi"], a).otherwise(let(F.floor((a["lo"] + a["hi"]) / 2).cast("int"), middle))

        return F.aggregate(steps, F.struct((i + 1).alias("lo"), F.col("__n").alias("hi")), halve, lambda a: a["hi"])

    def described(i: Column, j: Column) -> Column:
        a, b = F.get("__s", i)["char_start"], F.get("__s", j - 1)["char_end"]
        return F.struct(i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b"), (F.get("__sums", j) - F.get("__sums", i)).cast("int").alias("n"))

    # The fold looks at a window only where one may begin, and at its text only if its size fits.
    window = "array<struct<i:int,j:int,a:int,b:int,n:int,t:string>>"
    state = lambda out, last, following: F.struct(out.alias("out"), last.alias("last"), following.alias("next"))
    none = state(F.array().cast(window), F.lit(-(10**9)), F.lit(0))

    def tried(a: Column, w: Column) -> Column:
        kept = lambda t: F.when(self_contained(t), state(F.concat(a["out"], F.array(F.struct(*(w[c].alias(c) for c in ("i", "j", "a", "b", "n")), t.alias("t")))), w["i"], w["j"])).otherwise(a)
        return F.when(w["n"].between(least, most), let(stripped(F.substr("full_text", w["a"] + 1, w["b"] - w["a"])), kept)).otherwise(a)

    def step(a: Column, i: Column) -> Column:
        return F.when((i < a["next"]) | (i - a["last"] < apart), a).otherwise(let(end_of(i), lambda j: let(described(i, j), lambda w: tried(a, w))))

    df = df.withColumn("__w", F.aggregate(F.sequence(F.lit(0), F.col("__n") - 1), none, step, lambda a: a["out"]))
    rows = df.select("doc_id", "doc_type", "sections", "pages", F.explode_outer("__w").alias("w")).where("w is not null")  # outer: a plain one infers filters that compute its array again
    section = containing(F.col("sections"), F.col("w.a"))
    return rows.select(
        "doc_id", "doc_type", F.col("w.i").alias("first_sentence"), F.col("w.a").alias("char_start"), F.col("w.b").alias("char_end"), F.col("w.n").alias("n_tokens"), F.col("w.t").alias("passage_text"),
        F.coalesce(section["heading"], F.lit("")).alias("section_title"), F.coalesce(section["section_number"], F.lit("")).alias("section_number"), page_at(F.col("pages"), F.col("w.a")).alias("page_number"),
    )


def sample(found: DataFrame, n: int, module: str, seed: int = 42, per_doc: int = PER_DOC) -> DataFrame:
    """n candidates: documents' types take turns, at most `per_doc` of a document, in an order drawn by a hash of the seed.

    A document's own candidates are cut first, so a large document sends few rows on.
    """
    draw = lambda *c: F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(x).cast("string") for x in c]))
    own = found.withColumn("draw", draw("doc_id", "first_sentence")).withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("draw", "first_sentence"))).where(F.col("k") <= per_doc)
    turn = own.withColumn("turn", F.row_number().over(W.partitionBy("doc_type").orderBy("draw", "doc_id", "first_sentence"))).where(F.col("turn") <= n)
    first = turn.orderBy("turn", draw("doc_type"), "doc_type").limit(n)
    numbered = first.withColumn("no", F.row_number().over(W.orderBy("turn", draw("doc_type"), "doc_type")) - 1)  # n rows
    return numbered.withColumn("passage_id", F.format_string(f"{module}_p%03d", "no")).drop("draw", "k", "turn", "no")


def distribution(passages: DataFrame) -> DataFrame:
    """For each document type: passages, documents, and the most passages of one document."""
    per_doc = passages.groupBy("doc_type", "doc_id").count()
    return per_doc.groupBy("doc_type").agg(F.sum("count").alias("n_passages"), F.count("*").alias("n_docs"), F.max("count").alias("max_per_doc"))


def parsed_questions(response: Column, n: int) -> Column:
    """At most n questions of a response (a JSON list of objects, or an object's `questions`): those with a text, their
    concepts without blanks."""
    kind = "array<struct<question:string,question_type:string,difficulty:string,key_concepts:array<string>>>"
    body = json_text(response)
    items = F.coalesce(F.from_json(body, kind), F.from_json(F.get_json_object(body, "$.questions"), kind))
    kept = F.filter(items, lambda q: stripped(F.coalesce(q["question"], F.lit(""))) != "")
    clean = lambda q: F.struct(stripped(q["question"]).alias("question"), F.coalesce(q["question_type"], F.lit("")).alias("question_type"), F.coalesce(q["difficulty"], F.lit("")).alias("difficulty"), F.coalesce(F.filter(F.transform(q["key_concepts"], stripped), lambda c: c != ""), F.array().cast("array<string>")).alias("key_concepts"))
    return F.slice(F.transform(kept, clean), 1, n)


def question_pairs(passages: DataFrame, questions: DataFrame, references: DataFrame | None = None, n: int = 2, model: str = "default") -> DataFrame:
    """Question pairs of both tracks from passages and responses (passage_id, response).

    Track A has the passage's place; track B a reference answer, from a responses table by prompt, and an empty one where
    that has none. A passage without a usable response has no questions. Ids are stable.
    """
    asked = passages.join(questions, "passage_id").select("*", F.posexplode(parsed_questions(F.col("response"), n)).alias("no", "q"))
    tracks = asked.withColumn("track", F.explode(F.array(F.lit("A"), F.lit("B"))))
    prompt = F.concat(F.lit("Answer from the passage only.\n\nPassage:\n"), "passage_text", F.lit("\n\nQuestion: "), F.col("q.question"))
    tracks = answered(tracks.withColumn("prompt", prompt), references, into="reference")
    only = lambda t, c: F.when(F.col("track") == t, c)
    return tracks.select(
        uuid5(F.concat_ws("|", "passage_id", F.concat(F.lit("q"), F.col("no").cast("string")))).alias("qa_id"), "track", "module", "q.question", "q.question_type", "q.difficulty", "q.key_concepts",
        F.col("passage_id").alias("source_passage_id"), F.col("passage_text").alias("source_passage_text"), only("A", F.col("char_start")).alias("char_start"), only("A", F.col("char_end")).alias("char_end"),
        only("A", F.col("doc_id")).alias("source_doc_id"), only("B", F.coalesce("reference", F.lit(""))).alias("reference_answer"), only("B", F.lit(model)).alias("reference_answer_model"),
    )


def qa_distribution(pairs: DataFrame) -> DataFrame:
    """(measure, value, n): pairs of each track, reference answers that aren't blank, types and difficulties in track A."""
    tracks = pairs.groupBy(F.lit("track").alias("measure"), F.col("track").alias("value")).agg(F.count("*").alias("n"))
    answers = pairs.where(F.trim(F.coalesce("reference_answer", F.lit(""))) != "").groupBy(F.lit("reference").alias("measure"), F.lit("present").alias("value")).agg(F.count("*").alias("n"))
    only_a = pairs.where("track = 'A'")
    kinds = [only_a.groupBy(F.lit(c).alias("measure"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("question_type", "difficulty")]
    return tracks.unionAll(answers).unionAll(kinds[0]).unionAll(kinds[1])


def track(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.where(F.col("track") == name)


def qa_records(pairs: DataFrame) -> DataFrame:
    """(qa_id, record): each pair as JSON without its nulls, but for char_start and char_end, which always stand in it."""
    place = F.concat(*(x for c in ("char_start", "char_end") for x in (F.lit(f'"{c}":'), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(","))))
    rest = F.to_json(F.struct(*(c for c in pairs.columns if c not in ("char_start", "char_end"))))
    return pairs.select("qa_id", F.concat(F.lit("{"), place, F.substr(rest, F.lit(2))).alias("record"))
