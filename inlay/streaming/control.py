"""The control loop: periods of steps, state handed from period to period, texts placed per period."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inlay.evaluation.metrics import control_key
from inlay.functions.tokens import int_div
from inlay.geometry import Geometry
from inlay.operators.permutation import Permutation, resolve_permuted
from inlay.operators.placement import KEY, spans
from inlay.operators.reindex import reindex
from inlay.plans.experiments import gate_and_wrap, place_sequences
from inlay.staging import materialize
from inlay.streaming.snapshots import Snapshots

STATE_SCHEMA = (
    "experiment string, step bigint, state map<string,double>, whole string, texts array<string>, revision bigint, ignored bigint"
)
HANDED_SCHEMA = "experiment string, step bigint, whole string"

# (state, step since start, total steps, observed totals, **arguments) -> new state, or new state and texts
ControlProgram = Callable[..., dict | tuple[dict, list[str]]]


@dataclass(frozen=True)
class Control:
    """The program of an experiment, the state it starts from (None: it needs one that is handed on), its arguments."""

    program: ControlProgram
    initial: dict | None = None
    arguments: Mapping[str, object] = field(default_factory=dict)


def periods(steps: DataFrame, start: int, end: int, every: int) -> DataFrame:
    """Control periods covering ``steps(step)``: first step and length, the last one cut at ``end``."""
    first = F.lit(start) + int_div(F.col("step") - start, every) * every
    inside = steps.where(F.col("step").between(start, end - 1))
    return inside.select(first.cast("bigint").alias("period_step")).distinct().withColumn(
        "n_steps", F.least(F.lit(every).cast("bigint"), F.lit(end).cast("bigint") - F.col("period_step"))
    )


def period_of(step: Column, every: int, start: int = 0) -> Column:
    """Number of the period, counted from ``start``."""
    return int_div(step - start, every)


def merge_observations(rows: DataFrame, start: int, end: int, every: int) -> DataFrame:
    """Totals per experiment and period, merged inside each Arrow batch before any shuffle.

    ``rows`` holds ``experiment, step, amount`` with whole-number amounts.  Steps outside
    ``[start, end)`` are counted under a null period.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inside = batch["step"].between(start, end - 1)
            first = start + (batch["step"] - start) // every * every
            batch["step"] = first.where(inside).astype("Int64")
            grouped = batch.groupby(["experiment", "step"], as_index=False, dropna=False)
            yield grouped.agg(n=("amount", "size"), amount=("amount", "sum"))

    return rows.select("experiment", "step", "amount").mapInPandas(
        merge, "experiment string, step bigint, n bigint, amount bigint"
    )


class ControlState(StatefulProcessor):
    """Runs the control program over the periods of each experiment, in step order.

    Totals of the periods and the state behind each of them are kept, so a period may be spread
    over any number of micro-batches and rows may come late: the program runs again from the first
    period that changed, with the state of the period before it, up to the last one seen, periods without
    rows included.  Each row that comes out carries the number of rows seen so far; of several for one
    period the largest holds.

    A state handed on from an earlier run takes the place of the initial one; its periods are
    closed.  With ``keep``, so do periods more than ``keep`` periods behind the last one: only
    the state behind them stays.  Rows of closed periods and of steps outside the run are counted as
    ignored.  An experiment without any state is skipped: its periods come out with a null state.
    """

    def __init__(self, controls: Callable[[str], Control], start: int, end: int, every: int, keep: int | None = None):
        self.controls = controls
        self.start, self.end, self.every, self.keep = start, end, every, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getMapState("totals", "step bigint", "n bigint, amount bigint")
        self.states = handle.getMapState("states", "step bigint", "whole string")
        self.counts = handle.getValueState("counts", "seen bigint, ignored bigint")
        # first open period, last one seen
        self.open = handle.getValueState("open", "first bigint, last bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Take over the last state of an earlier run."""
        last = initialState.sort_values("step").iloc[-1]
        step = int(last["step"])
        self.states.updateValue((step,), (last["whole"],))
        self.open.update((step + self.every, step))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[int]] = {}
        seen, ignored = self.counts.get() if self.counts.exists() else (0, 0)
        first, last = self.open.get() if self.open.exists() else (self.start, self.start - self.every)
        for chunk in rows:
            for step, n, amount in zip(chunk["step"], chunk["n"], chunk["amount"]):
                seen += int(n)
                if pd.isna(step) or step < first:
                    ignored += int(n)
                    continue
                total = fresh.setdefault(int(step), [0, 0])
                total[0] += int(n)
                total[1] += int(amount)
        self.counts.update((seen, ignored))
        out = self.run(key[0], fresh, first, last, (seen, ignored)) if fresh else []
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE_SCHEMA.split(", ")])

    def run(self, experiment: str, fresh: dict, first: int, last: int, counts: tuple) -> list[tuple]:
        """Add ``fresh`` totals and run the program again from the first period they change."""
        for step, (n, amount) in fresh.items():
            if self.totals.containsKey((step,)):
                before = self.totals.getValue((step,))
                n, amount = n + before[0], amount + before[1]
            self.totals.updateValue((step,), (n, amount))
        control = self.controls(experiment)
        begin, end = min(*fresh, last + self.every), max(*fresh, last)
        before = begin - self.every
        if self.states.containsKey((before,)):
            state = json.loads(self.states.getValue((before,))[0])
        else:
            state = None if control.initial is None or before >= first else dict(control.initial)
        out = []
        for step in range(begin, end + 1, self.every):
            n, amount = self.totals.getValue((step,)) if self.totals.containsKey((step,)) else (0, 0)
            numbers, whole, texts = None, None, []
            if state is not None:
                seen = {"n": n, "amount": amount}
                result = control.program(state, step - self.start, self.end - self.start, seen, **control.arguments)
                state, texts = result if isinstance(result, tuple) else (result, [])
                whole = json.dumps(state, sort_keys=True)
                state = json.loads(whole)
                numbers = {k: float(v) for k, v in state.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
                self.states.updateValue((step,), (whole,))
            out.append((experiment, step, numbers, whole, list(texts), *counts))
        if self.keep is not None:
            for step in range(first, max(first, end - self.keep * self.every), self.every):
                for kept, at in ((self.totals, step), (self.states, step - self.every)):
                    if kept.containsKey((at,)):
                        kept.removeKey((at,))
            first = max(first, end - self.keep * self.every)
        self.open.update((first, end))
        return out

    def close(self) -> None:
        pass


def control_state(
    rows: DataFrame,
    program: ControlProgram | Mapping[str, Control],
    initial: dict | None,
    start: int,
    end: int,
    every: int,
    handed: DataFrame | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Streaming ``rows(experiment, step, amount)`` to rows of :data:`STATE_SCHEMA`.

    ``program`` with ``initial`` holds for all experiments, or there is a :class:`Control` for each.
    ``handed(experiment, step, whole)`` are states an earlier run ended with (:func:`last_states`).
    """
    shared = None if isinstance(program, Mapping) else Control(program, initial)
    table = dict(program) if shared is None else {}

    def controls(experiment: str) -> Control:
        return shared if shared is not None else table.get(experiment) or Control(lambda state, *_: state)

    merged = merge_observations(rows, start, end, every)
    return merged.groupBy("experiment").transformWithStateInPandas(
        statefulProcessor=ControlState(controls, start, end, every, keep),
        outputStructType=STATE_SCHEMA,
        outputMode="Append",
        timeMode="None",
        initialState=None if handed is None else handed.select("experiment", "step", "whole").groupBy("experiment"),
    )


def last_states(states: DataFrame) -> DataFrame:
    """State behind the last period of each experiment, to be handed on (:data:`HANDED_SCHEMA`); skipped ones have none."""
    held = latest_states(states).where("whole is not null")
    return held.groupBy("experiment").agg(F.max_by(F.struct("step", "whole"), "step").alias("_l")).select("experiment", "_l.*")


def skipped_periods(states: DataFrame) -> DataFrame:
    """``experiment, n_run, n_skipped``: periods with a state and periods skipped for want of one."""
    return latest_states(states).groupBy("experiment").agg(
        F.count("whole").alias("n_run"), F.count_if(F.col("whole").isNull()).alias("n_skipped")
    )


def typed_state(states: DataFrame) -> DataFrame:
    """All entries of the states as ``entries map<string,variant>``, texts among them."""
    return states.withColumn("entries", F.from_json("whole", "map<string,variant>"))


def latest_states(states: DataFrame) -> DataFrame:
    """The row that holds for each experiment and period, of all that a stream gave out."""
    rest = F.struct("state", "whole", "texts", "revision", "ignored")
    return states.groupBy("experiment", "step").agg(F.max_by(rest, "revision").alias("_r")).select("experiment", "step", "_r.*")


def control_texts(states: DataFrame) -> DataFrame:
    """Texts of the control program as ``(step, prompt_id, text)``, numbered by experiment, period and place."""
    each = states.select("step", "experiment", F.posexplode("texts").alias("at", "text"))
    prompt = F.xxhash64("experiment", "step", "at").bitwiseAND(F.lit((1 << 62) - 1))
    return each.select("step", prompt.alias("prompt_id"), "text")


def control_metrics(states: DataFrame) -> DataFrame:
    """Numbers of the state as metric rows ``(step, metric, value)``; other entries are no metrics."""
    entries = states.select("step", "experiment", F.explode("state").alias("key", "value"))
    return entries.select("step", control_key(F.col("experiment"), F.col("key")).alias("metric"), "value")


def place_period_texts(
    batch: DataFrame,
    tokens: Column,
    geometry: Geometry,
    every: int,
    seed: int,
    eos: int,
    occupied: DataFrame | None = None,
) -> DataFrame:
    """Texts ``batch(step, prompt_id, text)`` placed at random inside their period.

    All periods of a batch share the placement rounds; each has its own token
    range, and the period takes part in the draws.  Texts without room come back with a
    null position.
    """
    period = period_of(F.col("step"), every)
    first, last = geometry.token_range_columns(period * every, F.lit(every))
    rows = batch.where(F.col("text").isNotNull()).select(
        period.cast("int").alias("exp_id"),
        F.lit(0).alias("copy_no"),
        F.col("prompt_id").alias("seq_id"),
        tokens.alias("tokens"),
        first.alias("start"),
        (first + (last - first)).alias("end_excl"),
    )
    wrapped = gate_and_wrap(rows, geometry.sequence_length, eos)
    rows = materialize(wrapped.withColumn("n", F.size("tokens")), "period")
    result = place_sequences(rows, geometry.sequence_length, seed, occupied)
    placed = result.placed.select(*KEY, F.col("lo").alias("position"))
    return rows.select(*KEY, "tokens").join(placed, KEY, "left").select(
        F.col("exp_id").cast("bigint").alias("period"), "seq_id", "position", "tokens"
    )


PLAN_SCHEMA = "seq_id bigint, position bigint, tokens array<int>, batch_id bigint, period bigint"


RESOLVED_SCHEMA = "instance_id bigint, index bigint, ordinal bigint, pos int, tokens array<int>, period bigint"


def resolver(geometry: Geometry, every: int, order: Permutation) -> Callable[[DataFrame], DataFrame]:
    """Placed rows of one micro-batch re-addressed to corpus instances; ordinals count within the batch."""
    sequences = geometry.batch_sequences * every

    def resolve(plan: DataFrame) -> DataFrame:
        placed = plan.where("position is not null").select("position", "tokens")
        rows = resolve_permuted(reindex(placed, geometry.sequence_length), order)
        return rows.withColumn("period", int_div(F.col("index"), sequences))

    return resolve


def save_periods(
    plan: DataFrame, path: str, batch_id: int, resolve: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Store the rows one micro-batch placed, and their resolved form with ``resolve``, under one commit.

    A batch that runs again replaces its own rows, in both forms.  All batches of a path are stored in the same forms.
    """
    out = plan.select("seq_id", "position", "tokens", F.lit(batch_id).cast("bigint").alias("batch_id"), "period")
    derived = {} if resolve is None else {"resolved": resolve}
    Snapshots(plan.sparkSession, path).save(batch_id, out, PLAN_SCHEMA, **derived)


def stored_periods(spark, path: str) -> DataFrame:
    return Snapshots(spark, path).read(PLAN_SCHEMA)


def read_resolved(spark, path: str) -> DataFrame:
    """Everything that was placed, as rows of corpus instances."""
    return Snapshots(spark, path).read(RESOLVED_SCHEMA, "resolved")


def read_periods(spark, path: str) -> DataFrame:
    """Everything that was placed, by all micro-batches."""
    return stored_periods(spark, path).where("position is not null").drop("batch_id")


def read_unplaced(spark, path: str) -> DataFrame:
    """``period, seq_id, n`` of the texts their period had no room for."""
    return stored_periods(spark, path).where("position is null").select("period", "seq_id", F.size("tokens").alias("n"))


def period_plan_stream(
    texts: DataFrame,
    tokens: Column,
    path: str,
    geometry: Geometry,
    every: int,
    seed: int,
    eos: int,
    checkpoint: str,
    static: DataFrame | None = None,
    share_occupied: bool = True,
    resolve: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Plan every control period of a stream of ``texts(step, prompt_id, text)`` into ``path``.

    New texts avoid what other periods and other micro-batches placed and, unless
    ``share_occupied`` is off, the static plan.  A period may be spread over any number of batches;
    a batch reads the stored rows of the periods it has texts for.  ``resolve`` (see :func:`resolver`) adds a second form.
    """

    def plan(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "texts")
        period = period_of(F.col("step"), every)
        first, last = batch.agg(F.min(period), F.max(period)).first()
        theirs = F.col("position").isNotNull() & (F.col("batch_id") != batch_id)
        others = stored_periods(spark, path).where(theirs & F.col("period").between(first, last))
        held = spans(others)
        if static is not None and share_occupied:
            held = held.unionByName(spans(static))
        held = materialize(held, "held")
        save_periods(place_period_texts(batch, tokens, geometry, every, seed, eos, held), path, batch_id, resolve)

    return (
        texts.writeStream.foreachBatch(plan)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
