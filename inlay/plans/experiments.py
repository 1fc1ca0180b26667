"""From experiment specs to a placement plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.functions.tokens import fits, wrap_eos
from inlay.geometry import Geometry
from inlay.operators.placement import FEW, KEY, Placement, place_explicit, place_random, spans
from inlay.operators.sampling import apply_repetitions
from inlay.staging import materialize

MODES = ("explicit", "random", "random-range")
TYPES = ("add-texts-from-file", "add-tokens-from-file")
PLAN = "position bigint, tokens array<int>, exp_id int, copy_no int, seq_id bigint, phase int"


@dataclass
class Experiment:
    """One insertion experiment.

    ``rows`` holds ``seq_id, tokens`` and, for mode ``explicit``, ``position``.
    ``repetitions`` is ignored in explicit mode; random modes always wrap in EOS.
    """

    name: str
    rows: DataFrame
    mode: str = "random"
    type: str = "add-tokens-from-file"
    repetitions: float = 1.0
    start_token: int | None = None
    end_token: int | None = None
    add_eos: bool = False

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown experiment type: {self.type!r}")
        if self.mode not in MODES:
            raise ValueError(f"unknown insertion mode: {self.mode!r}")
        if self.mode == "explicit" and "position" not in self.rows.columns:
            raise ValueError("explicit mode needs a position for every sequence")
        if self.mode == "random-range" and (self.start_token is None or self.end_token is None):
            raise ValueError("random-range mode needs start_token and end_token")

    @property
    def phase(self) -> int:
        """Explicit experiments are placed before random ones."""
        return 0 if self.mode == "explicit" else 1


def spec_verdicts(specs: DataFrame) -> DataFrame:
    """``specs(name, mode, type, has_position, start_token, end_token)`` with the first broken rule as ``reason``.

    The rules are those :class:`Experiment` checks; null means that the spec holds.
    """
    mode, kind = F.coalesce("mode", F.lit("")), F.coalesce("type", F.lit(""))
    reason = (
        F.when(~kind.isin(*TYPES), F.lit("unknown type"))
        .when(~mode.isin(*MODES), F.lit("unknown mode"))
        .when((mode == "explicit") & ~F.coalesce("has_position", F.lit(False)), F.lit("no position"))
        .when((mode == "random-range") & (F.col("start_token").isNull() | F.col("end_token").isNull()), F.lit("no range"))
    )
    return specs.withColumn("reason", reason)


@dataclass
class Plan:
    """The merged plan, what found no room, and the per-experiment overview."""

    placements: DataFrame  # PLAN columns, position is unique
    unplaced: DataFrame  # exp_id, copy_no, seq_id, n
    summary: DataFrame


def spec_table(spark: SparkSession, experiments: Sequence[Experiment], start: int, end_excl: int) -> DataFrame:
    """Specs in processing order: explicit first, then random, each in given order."""
    rows = []
    for exp_id, exp in enumerate(experiments):
        ranged = exp.mode == "random-range"
        low = exp.start_token if ranged else start
        high = exp.end_token if ranged else end_excl
        outside = ranged and (low < start or high > end_excl)
        eos = True if exp.phase else exp.add_eos
        rows.append((exp_id, exp.name, exp.mode, exp.phase, low, high, eos, outside))
    return spark.createDataFrame(
        rows,
        "exp_id int, exp_name string, mode string, phase int, range_start bigint, range_end bigint,"
        " eos_wrapping boolean, outside_training_range boolean",
    ).orderBy("phase", "exp_id")


def gate_and_wrap(rows: DataFrame, length: int, eos: int) -> DataFrame:
    """Drop empty and overlong sequences, wrap the rest in EOS."""
    return rows.where(fits(F.col("tokens"), length)).withColumn("tokens", wrap_eos(F.col("tokens"), length, eos))


def length_gate_counts(rows: DataFrame, length: int) -> DataFrame:
    size = F.size("tokens")
    return rows.agg(
        F.count_if(size > length).alias("n_overlong"),
        F.count_if(size == 0).alias("n_empty"),
        F.count_if(size.between(1, length)).alias("n_kept"),
    )


def length_profile(rows: DataFrame) -> DataFrame:
    """Shortest, longest and second-longest distinct length (null when all are equal)."""
    size = F.size("tokens")
    longest = rows.agg(F.max(size)).first()[0]  # one number
    second = F.max(F.when(size < F.lit(longest).cast("int"), size))
    return rows.agg(F.min(size).alias("min_len"), F.max(size).alias("max_len"), second.alias("second_max_len"))


def explicit_rows(experiments: Sequence[Experiment], geometry: Geometry, eos: int) -> DataFrame | None:
    """All explicit rows with their experiment; EOS wrapping may not drop a row."""
    out = None
    for exp_id, exp in enumerate(experiments):
        if exp.mode != "explicit":
            continue
        rows = exp.rows.select("seq_id", "tokens", F.col("position").cast("bigint").alias("position"))
        if exp.add_eos:
            length = geometry.sequence_length
            unfit = F.concat(F.lit("sequences and positions differ: cannot wrap sequence "), F.col("seq_id"))
            wrapped = F.when(fits(F.col("tokens"), length), wrap_eos(F.col("tokens"), length, eos)).otherwise(
                F.raise_error(unfit).cast("array<int>")
            )
            rows = rows.withColumn("tokens", wrapped)
        rows = rows.withColumn("exp_id", F.lit(exp_id))
        out = rows if out is None else out.unionByName(rows)
    return out


def random_rows(
    experiments: Sequence[Experiment], geometry: Geometry, start: int, end_excl: int, seed: int, eos: int
) -> DataFrame | None:
    """All random rows, sampled or repeated, wrapped, with their placement range."""
    out = None
    for exp_id, exp in enumerate(experiments):
        if exp.mode == "explicit":
            continue
        low, high = (exp.start_token, exp.end_token) if exp.mode == "random-range" else (start, end_excl)
        geometry.check_range(low, high)
        chosen = apply_repetitions(exp.rows.select("seq_id", "tokens"), ["seq_id"], exp.repetitions, seed + exp_id)
        rows = gate_and_wrap(chosen, geometry.sequence_length, eos).withColumns(
            {
                "exp_id": F.lit(exp_id),
                "start": F.lit(low).cast("bigint"),
                "end_excl": F.lit(high).cast("bigint"),
            }
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def build_plan(
    spark: SparkSession,
    experiments: Sequence[Experiment],
    geometry: Geometry,
    start: int,
    end_excl: int,
    seed: int = 42,
    eos: int = 0,
    occupied: DataFrame | None = None,
) -> Plan:
    """Two-phase plan: explicit rows keep their positions, random rows avoid them and each other."""
    specs = spec_table(spark, experiments, start, end_excl)
    plan = spark.createDataFrame([], PLAN)
    unplaced = spark.createDataFrame([], "exp_id int, copy_no int, seq_id bigint, n int")
    sizes = spark.createDataFrame([], "exp_id int, n int")
    held = occupied
    fixed = explicit_rows(experiments, geometry, eos)
    if fixed is not None:
        fixed = place_explicit(materialize(fixed, "explicit"), held)
        plan = plan.unionByName(fixed.withColumn("copy_no", F.lit(0)).withColumn("phase", F.lit(0)))
        sizes = sizes.unionByName(fixed.select("exp_id", F.size("tokens").alias("n")))
        taken = spans(fixed)
        held = taken if held is None else held.unionByName(taken)
    loose = random_rows(experiments, geometry, start, end_excl, seed, eos)
    if loose is not None:
        loose = materialize(loose.withColumn("n", F.size("tokens")), "random")
        result = place_sequences(loose, geometry.sequence_length, seed, held)
        found = result.placed.select(*KEY, F.col("lo").alias("position"))
        plan = plan.unionByName(
            loose.select(*KEY, "tokens").join(found, KEY).withColumn("phase", F.lit(1))
        )
        sizes = sizes.unionByName(result.placed.select("exp_id", "n"))
        unplaced = unplaced.unionByName(result.unplaced)
    return Plan(plan, unplaced, placement_summary(sizes, specs))


def place_sequences(
    rows: DataFrame, length: int, seed: int, occupied: DataFrame | None = None, few: int | None = FEW
) -> Placement:
    """Random placement of ``rows(KEY, tokens | n, start, end_excl)``; tokens stay out of the rounds."""
    size = F.col("n") if "n" in rows.columns else F.size("tokens")
    narrow = rows.select(*KEY, size.alias("n"), "start", "end_excl")
    return place_random(narrow, length, seed, occupied, few=few)


def static_plan(
    spark: SparkSession,
    experiments: Sequence[Experiment],
    geometry: Geometry,
    step: int,
    steps: int,
    seed: int = 42,
    eos: int = 0,
) -> Plan:
    """The plan for a training run of ``steps`` steps from ``step``."""
    start, end_excl = geometry.token_range(step, steps)
    return build_plan(spark, experiments, geometry, start, end_excl, seed, eos)


def placement_summary(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """Per experiment: what was placed, from ``sizes(exp_id, n)``; experiments without a placement show zeros.

    Token lists are not asked for, so they need not meet their places.
    """
    placed = sizes.groupBy("exp_id").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("n").alias("n_tokens"),
        F.min("n").alias("min_len"),
        F.max("n").alias("max_len"),
    )
    counts = ("sequences", "n_tokens", "min_len", "max_len")
    filled = {c: F.coalesce(c, F.lit(0)) for c in counts}
    return specs.join(placed, "exp_id", "left").withColumns(filled)


def inserted_fraction(plan: DataFrame, training_tokens: int) -> DataFrame:
    """Total inserted tokens and their percentage of the training range (0 for an empty range)."""
    total = F.coalesce(F.sum(F.size("tokens")), F.lit(0))
    share: Column = F.lit(100.0) * total / F.nullif(F.lit(training_tokens).cast("double"), F.lit(0.0))
    return plan.agg(total.alias("total_tokens"), F.coalesce(share, F.lit(0.0)).alias("percent"))
