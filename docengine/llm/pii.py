"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust their scores.

DataFrame functions only. The pieces between a pattern's matches and the matches themselves give each match's place in code
points; running sums are taken over blocks of BLOCK matches, so that a text with very many matches costs little more than
linear time. All loops in the patterns are possessive or disjoint, and a match can only begin where the one before ended
or where its first run of characters begins: the places found are those of the plain patterns, in linear time and without
deep recursion, on texts of any length. IBANs alone have a closer one: their country's length ends them, so that words,
years or other IBANs behind one are not taken along.

Null and empty texts have no spans. Repeated rows give repeated rows; other columns of the input are not read, and an
empty table gives an empty one. Spans of one kind never overlap; spans of two kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
NEAR = 48

# The kinds with their patterns, in the order in which spans are listed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# The length of each country's account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SIZED = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
# Of the country's length if such a number stands there, else of any length, up to where one of a country's length begins.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{SIZED}|[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!{SIZED}))?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN}
KINDS = list(PATTERNS)
# What a span of each kind scores by itself, and the words nearby that raise or lower it by STEP.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.55}
RAISING = {
    "email": r"(?i)e-?mail|mailto|contact|write to", "ip": r"(?i)\bip\b|address|host|server|login", "card": r"(?i)card|visa|master|amex|credit|debit|pay",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|contact", "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
LOWERING = {"email": r"(?i)example", "ip": r"(?i)version|release|section", "card": r"(?i)isbn|order no|serial", "phone": r"(?i)isbn|serial", "iban": r"(?i)serial|part no"}
STEP = 0.1


def luhn(digits: Column) -> Column:
    """Do the digits (a text of digits only) pass Luhn's check."""
    def term(i):
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Does the account number (letters and digits only) leave 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """Whether a match is of the kind: its lengths, ranges and checksums."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:[0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def running(lengths: Column, sums: Column, upto: Column) -> Column:
    """The sum of the first `upto` lengths; sums: of each whole block of BLOCK of them."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = F.floor(upto / BLOCK).cast("int")
    return total(F.slice(sums, F.lit(1), blocks)) + total(F.slice(lengths, blocks * BLOCK + 1, upto - blocks * BLOCK))


def spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with `into`: array of (kind, start, end, score, base) in code points, end exclusive, by kind as listed and start.

    `base` marks spans that stay whatever stands nearby. The others need a score of 0.5: cards of 13 to 15 digits have it with
    a raising word nearby, IBANs (confirmed by their checksum) unless a lowering one is.
    A column that has that name already is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    own = "__pii_text"
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(own))
    df = df.withColumn("__pii_some", F.col(own).rlike("@|[0-9]"))
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__m_{k}": F.when(F.col("__pii_some") & (F.contains(own, F.lit({"email": "@", "phone": "+"}[k])) if k in ("email", "phone") else F.lit(True)), F.regexp_extract_all(own, F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    # Lengths, in turn, of the text before a match and of the match.
    lengths = lambda k: F.flatten(F.zip_with(F.transform(F.split(own, PATTERNS[k], -1), F.length), F.transform(f"__m_{k}", F.length), lambda a, b: F.array(a.cast("long"), F.coalesce(b, F.lit(0)).cast("long"))))
    df = df.withColumns({f"__l_{k}": F.when(F.size(f"__m_{k}") > 0, lengths(k)).otherwise(F.array().cast("array<bigint>")) for k in KINDS})
    blocks = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"__l_{k}") / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(f"__l_{k}", b * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumns({f"__s_{k}": F.when(F.size(f"__l_{k}") > 0, blocks(k)).otherwise(F.array().cast("array<bigint>")) for k in KINDS})

    def found(k: str) -> Column:
        matches, lens, sums = F.col(f"__m_{k}"), F.col(f"__l_{k}"), F.col(f"__s_{k}")
        numbered = F.filter(F.transform(matches, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: confirmed(k, x["m"]))

        def span(x: Column) -> Column:
            start = running(lens, sums, 2 * x["i"] + 1)
            return F.struct(F.lit(k).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"))

        def scored(x: Column) -> Column:
            begin = F.greatest(x["start"] - NEAR, F.lit(0)).cast("int")
            near = F.concat(F.substr(F.col(own), begin + 1, (x["start"] - begin).cast("int")), F.lit(" "), F.substr(F.col(own), (x["end"] + 1).cast("int"), F.lit(NEAR)))
            up, down = near.rlike(RAISING[k]), near.rlike(LOWERING[k])
            short = (F.length(F.regexp_replace(x["m"], "[^0-9]", "")) < 16) if k == "card" else F.lit(False)
            value = F.lit(SCORES[k]) + F.when(up, STEP).otherwise(0.0) - F.when(down, STEP).otherwise(0.0) - F.when(short, 0.35).otherwise(0.0)
            base = ~short if k == "card" else F.lit(k != "iban")
            return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value.alias("score"), base.alias("base"))

        return F.filter(F.transform(F.transform(numbered, span), scored), lambda x: x["base"] | (x["score"] >= 0.5))

    df = df.withColumns({f"__f_{k}": F.when(F.size(f"__m_{k}") > 0, found(k)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")) for k in KINDS})
    return df.select(*kept, F.concat(*(F.col(f"__f_{k}") for k in KINDS)).alias(into))


def listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count of base spans for each kind, base_sha256, spans, and the largest score (0 without spans)."""
    df = spans(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])
    count = lambda k: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    best = F.round(F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)), 6).alias("score")
    return df.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), best)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span's characters replaced by its kind in angle brackets; overlapping spans become one, with the
    first one's kind. Other columns stay as they are; null texts stay null."""
    df = spans(docs, text, "__pii_spans").withColumn("__sorted", F.sort_array(F.transform("__pii_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    # A fold over the spans in order: the text so far, in pieces, and how far it has been read.
    start = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        piece = F.concat(F.substr(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["pieces"], F.array(piece)).alias("pieces"), x["end"].alias("at"))).otherwise(
            F.struct(acc["pieces"].alias("pieces"), F.greatest(acc["at"], x["end"]).alias("at"))
        )

    folded = F.aggregate("__sorted", start, step, lambda acc: F.concat(F.array_join(acc["pieces"], ""), F.substr(F.col(text), (acc["at"] + 1).cast("int"))))
    new = F.when(F.size("__sorted") > 0, folded).otherwise(F.col(text)).alias(text)
    return df.select(*(new if c == text else F.col(c) for c in docs.columns))


def _oracle() -> str:
    """The same rows from DuckDB, with the plain patterns."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": PHONE, "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sql = f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT WHEN reverse({digits})[i]::INT > 4 THEN 2 * reverse({digits})[i]::INT - 9 ELSE 2 * reverse({digits})[i]::INT END)) % 10 = 0)"
    code = "ascii(c)"
    bare = "replace(m, ' ', '')"
    mod_sql = f"(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {code}::BIGINT)), lambda r, x: CASE WHEN x < 65 THEN (r * 10 + x - 48) % 97 ELSE (r * 100 + x - 55) % 97 END) = 1)"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_full_match(ltrim(p, '0'), '[0-9]?[0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5]'))) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn_sql} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"CASE WHEN length({bare}) BETWEEN 15 AND 34 THEN {mod_sql} ELSE false END",
    }
    parts = []
    for n, k in enumerate(KINDS):
        pattern = plain[k].replace("'", "''")
        short = f"(length({digits}) < 16)" if k == "card" else "false"
        near = f"substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || ' ' || substr(t, s + length(m) + 1, {NEAR})"
        up, down = RAISING[k].replace("(?i)", ""), LOWERING[k].replace("(?i)", "")
        value = f"{SCORES[k]} + CASE WHEN regexp_matches({near}, '{up}', 'i') THEN {STEP} ELSE 0.0 END - CASE WHEN regexp_matches({near}, '{down}', 'i') THEN {STEP} ELSE 0.0 END - CASE WHEN {short} THEN 0.35 ELSE 0.0 END"
        base = f"NOT {short}" if k == "card" else "false" if k == "iban" else "true"
        parts.append(f"""
        SELECT row_id, '{k}' AS kind, {n} AS k, s, s + length(m) AS e, {base} AS base, round(({value})::DOUBLE, 6) AS score FROM (
          SELECT row_id, t, m, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
            SELECT row_id, t, ms, ps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (
              SELECT row_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d)))
        WHERE {valid[k]}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE base OR score >= 0.5),
g AS (SELECT row_id, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip,
  count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (base) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans, max(score) AS score FROM f GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (row_id)"""


ORACLE_SQL = _oracle()
