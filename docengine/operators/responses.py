"""Model responses as a table: prompts are columns, answers come from a join, absent answers take each caller's fallback.

A responses table has (key, response); `key_of` is the SHA-256 of the model's settings and the prompt. Answers that a live
model gives are appended to the table and so are a cache.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import stripped


def key_of(prompt: Column, model: str = "default", system: Column | None = None, max_tokens: int = 2000, temperature: float = 0.0) -> Column:
    system = F.lit("") if system is None else F.coalesce(system, F.lit(""))
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(str(max_tokens)), F.lit(str(temperature)), system, prompt), 256)


def answered(prompts: DataFrame, responses: DataFrame | None, prompt: str = "prompt", into: str = "response", **settings) -> DataFrame:
    """prompts with `into`: the response to each prompt, null where there is none."""
    if responses is None:
        return prompts.withColumn(into, F.lit(None).cast("string"))
    known = responses.groupBy("key").agg(F.min("response").alias(into)).withColumnRenamed("key", "__key")
    return prompts.withColumn("__key", key_of(F.col(prompt), **settings)).join(known, "__key", "left").drop("__key")


def json_text(response: Column) -> Column:
    """What stands within a code fence, if there is one; stripped."""
    fenced = F.regexp_extract(response, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return stripped(F.when(fenced != "", fenced).otherwise(response))


def strings(response: Column, field: str) -> Column:
    """An array of texts from a JSON list, or from a JSON object's `field`; anything else is one text. Null stays null."""
    body = json_text(response)
    listed = F.from_json(body, "array<string>")
    within = F.from_json(F.get_json_object(body, f"$.{field}"), "array<string>")
    return F.when(F.startswith(body, F.lit("[")) & listed.isNotNull(), listed).when(F.startswith(body, F.lit("{")) & within.isNotNull(), within).when(body.isNotNull(), F.array(body))


REPAIR = "\n\nThe answer below is not valid JSON. Give the same answer as valid JSON only.\n\n"


def json_answered(prompts: DataFrame, responses: DataFrame | None, prompt: str = "prompt", into: str = "json", rounds: int = 1, **settings) -> DataFrame:
    """prompts with `into`, the response as JSON text, and `error`. A response that is not JSON is asked for again with the
    prompt and the bad answer, up to `rounds` times; what is still no JSON, or absent, gives null and an error."""
    df = prompts.withColumn("__ask", F.col(prompt)).withColumns({into: F.lit(None).cast("string"), "__said": F.lit(None).cast("string")})
    for _ in range(rounds + 1):
        df = answered(df, responses, "__ask", "__new", **settings)
        body = json_text(F.col("__new"))
        good = F.try_parse_json(body).isNotNull()
        said = F.coalesce("__new", "__said")
        df = df.withColumns({into: F.coalesce(into, F.when(good, body)), "__said": said, "__ask": F.concat(F.col(prompt), F.lit(REPAIR), F.coalesce(said, F.lit("")))}).drop("__new")
    error = F.when(F.col(into).isNull(), F.when(F.col("__said").isNull(), "no response").otherwise("not valid JSON"))
    return df.withColumn("error", error).drop("__ask", "__said")


def cumulative(tokens: DataFrame) -> DataFrame:
    """A stream of tokens (query_id, token_no, token) as the text so far at each token."""
    from pyspark.sql import Window as W

    so_far = F.collect_list("token").over(W.partitionBy("query_id").orderBy("token_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    return tokens.withColumn("text", F.array_join(so_far, ""))
