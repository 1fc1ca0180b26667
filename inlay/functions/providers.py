"""Plug-ins that answer queries, and a bigram model built from joins for tests and baselines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inlay.operators.skew import spread_join
from inlay.staging import materialize

COUNTED = 1 << 21  # tokens whose pairs are counted together, before they are rows
PACKED = 1 << 31  # counts below this go into one number with a token


class Scorer(Protocol):
    """Prompts as token ids in, one log-probability per token out (the first is None)."""

    def logprobs(self, prompts: Sequence[Sequence[int]]) -> list[list[float | None]]: ...


class Generator(Protocol):
    """Prompts as token ids in, generated token ids out."""

    def generate(self, prompts: Sequence[Sequence[int]], max_tokens: int, temperature: float) -> list[list[int]]: ...


def score(prompts: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """``prompts(query_id, token_ids)`` with ``logprobs``; the scorer is made once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            batch["logprobs"] = scorer.logprobs([list(t) for t in batch["token_ids"]])
            yield batch

    rows = prompts.select("query_id", "token_ids")
    return rows.mapInPandas(run, "query_id bigint, token_ids array<int>, logprobs array<double>")


def generate(
    prompts: DataFrame, make_generator: Callable[[], Generator], max_tokens: int, temperature: float = 0.0
) -> DataFrame:
    """``prompts(query_id, token_ids)`` with ``generated`` token ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for batch in batches:
            batch["generated"] = generator.generate([list(t) for t in batch["token_ids"]], max_tokens, temperature)
            yield batch

    rows = prompts.select("query_id", "token_ids")
    return rows.mapInPandas(run, "query_id bigint, token_ids array<int>, generated array<int>")


class EchoModel:
    """Scorer and generator plug-in for tests: fixed prices per id, and the last id over and over."""

    def logprobs(self, prompts: Sequence[Sequence[int]]) -> list[list[float | None]]:
        return [[None, *[-math.log(2 + int(i) % 5) for i in ids[1:]]] if len(ids) else [] for ids in prompts]

    def generate(self, prompts: Sequence[Sequence[int]], max_tokens: int, temperature: float) -> list[list[int]]:
        return [[int(ids[-1])] * max_tokens if len(ids) else [] for ids in prompts]


def counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(prev, next, n)`` of lists of tokens, as counts over ``COUNTED`` tokens; ``prev`` of a first token is null."""
    for batch in batches:
        at = batch.column(0).offsets.to_numpy()
        flat = batch.column(0).values.slice(at[0], at[-1] - at[0])
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        ids = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint32)
        follows = np.append(False, known[:-1])
        follows[at[:-1] - at[0]] = False
        for first in range(0, len(ids), COUNTED):
            part = slice(first, first + COUNTED)
            after = ids[part].astype(np.uint64)
            keys = ids[max(0, first - 1) : first + len(after) - 1].astype(np.uint64) << np.uint64(32)
            keys = np.append(np.zeros(len(after) - len(keys), np.uint64), keys) | after
            for p in (True, False):
                for q in (True, False):
                    pairs, n = np.unique(keys[(follows[part] == p) & (known[part] == q)] & np.uint64(p * 0xFFFFFFFF << 32 | q * 0xFFFFFFFF), return_counts=True)
                    if len(pairs):
                        prev, then = (pairs >> np.uint64(32)).astype(np.uint32).view(np.int32), pairs.astype(np.uint32).view(np.int32)
                        columns = [pa.array(v) if there else pa.nulls(len(n), pa.int32()) for v, there in ((prev, p), (then, q))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["prev", "next", "n"])


@dataclass
class BigramModel:
    """Add-one bigram counts: ``pairs(prev, next, n)``, ``heads(prev, total)``, vocabulary size."""

    pairs: DataFrame
    heads: DataFrame
    vocabulary: int

    @classmethod
    def train(cls, docs: DataFrame) -> BigramModel:
        """Counts over ``docs(tokens)``; pairs are counted in Arrow batches before they become rows.

        The first token of a document counts as the successor of nothing, so the
        successors alone are the whole vocabulary.
        """
        lists = docs.where(F.size("tokens") > 0).select("tokens")
        # a pair comes once from each run of tokens; most pairs are rare, so a sum before they are dealt would not make them fewer
        spots = lists.mapInArrow(counted_pairs, "prev int, next int, n bigint").repartition("prev", "next")
        counted = materialize(spots.groupBy("prev", "next").agg(F.sum("n").alias("n")), "bigram")
        size = counted.select("next").distinct().count()
        pairs = counted.where("prev is not null")
        heads = pairs.groupBy("prev").agg(F.sum("n").alias("total"))
        return cls(pairs, heads, size)

    def score(self, prompts: DataFrame) -> DataFrame:
        """``prompts(query_id, token_ids)`` with ``logprobs``; every distinct pair is priced once."""
        token = lambda shift: F.get("token_ids", F.col("_at") + shift)
        spots = prompts.where(F.size("token_ids") > 1).select(
            "query_id", "token_ids", F.explode(F.sequence(F.lit(1), F.size("token_ids") - 1)).alias("_at")
        ).select("query_id", "_at", token(-1).alias("prev"), token(0).alias("next"))
        asked = spots.select("prev", "next").distinct()
        priced = asked.join(self.pairs, ["prev", "next"], "left")
        priced = spread_join(priced, self.heads, ["prev"], ["next"], "left")
        chance = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + F.lit(self.vocabulary))
        priced = priced.select("prev", "next", F.ln(chance).alias("lp"))
        known = spread_join(spots, priced, ["prev", "next"], ["query_id", "_at"])
        lists = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_at", "lp"))).alias("_s"))
        tail = F.coalesce(F.transform("_s", lambda s: s["lp"]), F.array().cast("array<double>"))
        first = F.when(F.size("token_ids") > 0, F.array(F.lit(None).cast("double"))).otherwise(
            F.array().cast("array<double>")
        )
        return prompts.select("query_id", "token_ids").join(lists, "query_id", "left").select(
            "query_id", "token_ids", F.concat(first, tail).alias("logprobs")
        )

    def followers(self) -> DataFrame:
        """``(prev, last)``: the most frequent successor of every known token, the smallest of equally frequent ones."""
        largest, gaps = self.pairs.agg(F.max("n"), F.count_if(F.col("next").isNull())).first()
        if gaps or (largest or 0) >= PACKED:
            best = F.max_by("next", F.struct("n", -F.col("next").cast("bigint"))).alias("last")
            return self.pairs.groupBy("prev").agg(best)
        # one number, which a hash aggregate can hold: the count, then the distance from the largest token
        most, low = F.lit((1 << 31) - 1).cast("bigint"), F.lit((1 << 32) - 1).cast("bigint")
        packed = F.max(F.shiftleft("n", 32) + (most - F.col("next"))).alias("_p")
        return self.pairs.groupBy("prev").agg(packed).select("prev", (most - F.col("_p").bitwiseAND(low)).cast("int").alias("last"))

    def continuations(self, max_tokens: int) -> DataFrame:
        """Greedy continuation of every known token: ``(prev, seq)``.

        The table doubles its length by joining itself on the last token, so
        ``log2(max_tokens)`` joins over the vocabulary replace one join per token.
        """
        table = self.followers().select("prev", F.array("last").alias("seq"), "last")
        for i in range(math.ceil(math.log2(max(1, max_tokens)))):
            table = materialize(table, f"greedy{i}")
            more = table.select(F.col("prev").alias("last"), F.col("seq").alias("_seq"), F.col("last").alias("_last"))
            joined = spread_join(table, more, ["last"], ["prev"], "left")
            none = F.array().cast("array<int>")
            table = joined.select(
                "prev", F.concat("seq", F.coalesce("_seq", none)).alias("seq"), F.col("_last").alias("last")
            )
        return table.select("prev", F.slice("seq", 1, max_tokens).alias("seq"))

    def generate(self, prompts: DataFrame, max_tokens: int) -> DataFrame:
        """``prompts(query_id, token_ids)`` with greedy ``generated`` tokens (empty after an unknown token)."""
        ends = prompts.withColumn("prev", F.try_element_at("token_ids", F.lit(-1)))
        joined = spread_join(ends, self.continuations(max_tokens), ["prev"], ["query_id"], "left")
        none = F.array().cast("array<int>")
        return joined.select("query_id", "token_ids", F.coalesce("seq", none).alias("generated"))
