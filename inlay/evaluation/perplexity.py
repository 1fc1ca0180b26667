"""Cross-entropy and perplexity over distinct prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_PROMPT_TOKENS = 4095  # fixed value: longest token prompt that is scored


def truncate(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("token_ids", F.slice("token_ids", 1, MAX_PROMPT_TOKENS))


def distinct_prompts(prompts: DataFrame, id_col: str = "query_id", by: str = "token_ids") -> DataFrame:
    """First row (smallest id) of every distinct prompt, compared by whole content."""
    others = [c for c in prompts.columns if c not in (id_col, by)]
    first = F.min(F.struct(id_col, *others)).alias("_first")
    return prompts.groupBy(by).agg(first).select(f"_first.{id_col}", by, *[f"_first.{c}" for c in others])


def scoring_input(prompts: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Cut, then de-duplicate: what goes to a scorer."""
    return distinct_prompts(truncate(prompts), id_col)


def perplexity(responses: DataFrame) -> DataFrame:
    """One row over ``logprobs`` lists; the first entry of each list is left out."""
    tail = F.slice("logprobs", F.lit(2), F.size("logprobs"))
    per_row = responses.select(
        F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v).alias("s"), F.size(tail).cast("bigint").alias("n")
    )
    loss = -F.sum("s") / F.nullif(F.sum("n"), F.lit(0))
    return per_row.agg(loss.alias("cross_entropy_loss"), F.exp(loss).alias("perplexity"))
