"""Explicit and seeded random placement of token sequences in the stream.

Random placement runs in rounds.  A round draws a slot (sequence) and an offset
for every waiting candidate, drops draws that meet the occupied set, groups the
rest of a slot into chains of touching intervals, and accepts the first candidate
of each chain in ``(exp_id, copy_no, seq_id)`` order.

A round makes one draw per candidate at first, and equal intervals of one slot are
merged before the shuffle: a slot never holds more rows than it has distinct
intervals, whatever the number of candidates.  Later rounds make more draws each and
keep the first free one; how many depends on the round alone.

Where a round would make more draws than intervals are held, the free space is measured first:
candidates longer than every gap of their range make no draw, and a draw whose slot has no gap
of its size is dropped before it is moved.  Neither could have been accepted.

Once few wait (unless the caller asks for all rounds), or after the last round, what is left is put into the gaps: all gaps of a
range are cut into cells of the largest waiting size that fits, and the candidates
take the cells in order, largest first.  Only a candidate that is longer than every gap of
its range stays unplaced.  Cells are counted per block of slots first; slots are listed in the
blocks alone that the candidates reach, so a range may be of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from inlay.functions.draws import draw
from inlay.functions.tokens import int_div
from inlay.operators.intervals import conflicting, self_conflicts
from inlay.operators.scan import grouped_ordinal, ordered_scan
from inlay.operators.skew import spread_join
from inlay.staging import materialize, new_path

KEY = ["exp_id", "copy_no", "seq_id"]
ROUNDS = 16  # rounds of draws before gaps are filled; changes the speed and the places, not what is placed
FEW = 200  # gaps are filled as soon as at most one candidate in so many waits
BLOCK_SLOTS = 4096  # slots whose free space is counted together
SINGLE_ROUNDS = 5  # rounds of one draw per candidate
MAX_DRAWS = 32
ROUND_SCHEMA = (
    "exp_id int, copy_no int, seq_id bigint, n int, start bigint, end_excl bigint, slot bigint, lo bigint, hi bigint"
)
PRUNE_ABOVE = 1_000_000  # occupied intervals from which they are pruned to the drawn slots
FEW_RANGES = 64  # ranges up to which candidates are held against the longest gap of their range
ROOM_SLOTS = 1 << 23  # touched slots up to which their longest gaps are broadcast; checked before


class PlacementError(ValueError):
    """A plan that breaks the placement rules; the message names offending rows."""


@dataclass
class Placement:
    """Placed rows (key, n, lo, hi, round), rows longer than every gap of their range (key, n),
    and per experiment how often a candidate went through a round without being placed."""

    placed: DataFrame
    unplaced: DataFrame
    waits: DataFrame  # exp_id, n_waits
    rounds: int


def empty_occupied(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "lo bigint, hi bigint")


def spans(plan: DataFrame) -> DataFrame:
    """Closed intervals a plan occupies."""
    end = F.col("position") + F.size("tokens") - 1
    return plan.where(F.size("tokens") > 0).select(F.col("position").cast("bigint").alias("lo"), end.alias("hi"))


def explicit_conflicts(rows: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """Rows ``(seq_id, position, tokens)`` that meet the occupied set or an earlier row."""
    batch = rows.where(F.size("tokens") > 0).select(
        "seq_id",
        F.col("position").cast("bigint").alias("lo"),
        (F.col("position") + F.size("tokens") - 1).alias("hi"),
    )
    found = self_conflicts(batch, ["hi", "seq_id"]).select("seq_id", "lo", "hi")
    found = found.withColumn("reason", F.lit("batch"))
    if occupied is not None:
        met = conflicting(batch, occupied, ["seq_id"]).withColumn("reason", F.lit("occupied"))
        found = found.unionByName(met)
    return found


def place_explicit(rows: DataFrame, occupied: DataFrame | None = None) -> DataFrame:
    """Non-empty rows at their stated positions; any overlap fails with the first few rows."""
    bad = explicit_conflicts(rows, occupied).orderBy("lo", "seq_id").limit(5).collect()
    if bad:
        named = "; ".join(f"seq {r.seq_id} at {r.lo}-{r.hi} ({r.reason})" for r in bad)
        raise PlacementError(f"insertion overlaps with existing insertion: {named}")
    return rows.where(F.size("tokens") > 0)


def range_violations(candidates: DataFrame, length: int) -> DataFrame:
    """One row with the number of candidates breaking each random-placement rule."""
    step = F.lit(length).cast("bigint")

    def count(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return candidates.agg(
        F.count(F.lit(1)).alias("n_rows"),
        count(F.col("start") % step != 0, "start_unaligned"),
        count(F.col("end_excl") % step != 0, "end_unaligned"),
        count(int_div(F.col("end_excl") - F.col("start"), step) <= 0, "no_sequence"),
        count(F.col("n") > length, "too_long"),
        count(F.col("n") < 1, "empty"),
    )


def draw_slots(waiting: DataFrame, length: int, seed: int, round_no: int, draws: int = 1) -> DataFrame:
    """Draws of one round as ``draw_no``, ``slot``."""
    step = F.lit(length).cast("bigint")
    tried = waiting.withColumn("draw_no", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    n_slots = int_div(F.col("end_excl") - F.col("start"), step)
    parts = (seed, *[F.col(k) for k in KEY], round_no, F.col("draw_no"))
    return tried.withColumn("slot", int_div(F.col("start"), step) + draw(*parts, "s") % n_slots)


def draw_offsets(drawn: DataFrame, length: int, seed: int, round_no: int) -> DataFrame:
    """Drawn slots with ``lo``, ``hi``; no draw crosses a sequence end."""
    step = F.lit(length).cast("bigint")
    parts = (seed, *[F.col(k) for k in KEY], round_no, F.col("draw_no"))
    offset = draw(*parts, "o") % (step - F.col("n") + 1)
    return drawn.withColumn("lo", F.col("slot") * step + offset).withColumn("hi", F.col("lo") + F.col("n") - 1)


def draw_positions(waiting: DataFrame, length: int, seed: int, round_no: int, draws: int = 1) -> DataFrame:
    """Draws of one round as ``draw_no``, ``slot``, ``lo``, ``hi``."""
    return draw_offsets(draw_slots(waiting, length, seed, round_no, draws), length, seed, round_no)


def by_slot(intervals: DataFrame, length: int) -> DataFrame:
    """Intervals cut at slot borders: ``(slot, lo, hi)``."""
    step = F.lit(length).cast("bigint")
    cut = intervals.select(
        "lo", "hi", F.explode(F.sequence(int_div(F.col("lo"), step), int_div(F.col("hi"), step))).alias("slot")
    )
    return cut.select(
        "slot",
        F.greatest("lo", F.col("slot") * step).alias("lo"),
        F.least("hi", (F.col("slot") + 1) * step - 1).alias("hi"),
    )


def free_of(drawn: DataFrame, held: DataFrame | None) -> DataFrame:
    """Rows ``(slot, lo, hi, ..., key)`` of ``drawn`` that meet no row of the disjoint ``held(slot, lo, hi)``."""
    if held is None:
        return drawn
    both = drawn.unionByName(held.select("slot", "lo", "hi"), allowMissingColumns=True)
    taken = F.col("key").isNull()
    slots = Window.partitionBy("slot")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up_to = slots.orderBy("lo", "hi", taken.desc()).rowsBetween(*so_far)
    behind = slots.orderBy(F.desc("lo"), F.desc("hi"), taken.asc()).rowsBetween(*so_far)
    # the held set is disjoint: only the nearest held rows can meet a candidate
    marked = both.withColumn("_prev", F.max(F.when(taken, F.col("hi"))).over(up_to)).withColumn(
        "_next", F.min(F.when(taken, F.col("lo"))).over(behind)
    )
    clear = (F.coalesce("_prev", F.lit(-1)) < F.col("lo")) & F.coalesce(F.col("_next") > F.col("hi"), F.lit(True))
    return marked.where(~taken & clear).drop("_prev", "_next")


def accept(free: DataFrame) -> DataFrame:
    """First key of every chain of touching intervals in a slot, with its interval."""
    ordered = Window.partitionBy("slot").orderBy("lo", "hi")
    reach = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("_reach") >= F.col("lo"), 0).otherwise(1)
    chain = F.sum(starts).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chained = free.withColumn("_reach", reach).withColumn("_chain", chain)
    first = chained.groupBy("slot", "_chain").agg(F.min(F.struct("key", "lo", "hi")).alias("_won"))
    return first.select("_won.key.*", "slot", "_won.lo", "_won.hi")


def draws_in(round_no: int) -> int:
    """Draws per candidate in a round."""
    return min(MAX_DRAWS, 1 << max(0, round_no - SINGLE_ROUNDS))


def play_round(
    waiting: DataFrame, held: DataFrame | None, length: int, seed: int, round_no: int, draws: int, crowded: bool = False
) -> DataFrame:
    """Accepted rows ``(KEY, slot, lo, hi)`` of one round; ``held`` is None while nothing is occupied.

    With ``crowded``, draws that cannot be accepted are dropped before the held rows meet the others.
    """
    key = F.struct(*KEY)
    if crowded and held is not None:
        drawn = draw_offsets(roomy_draws(waiting, held, length, seed, round_no, draws), length, seed, round_no)
        drawn = materialize(drawn.select(*KEY, "draw_no", "slot", "lo", "hi"), "drawn")
        held = held.join(drawn.select("slot").distinct(), "slot", "left_semi")
    else:
        drawn = draw_positions(waiting, length, seed, round_no, draws)
    if draws == 1:
        merged = drawn.groupBy("slot", "lo", "hi").agg(F.min(key).alias("key"))
        return accept(free_of(merged, held))
    free = free_of(drawn.select("slot", "lo", "hi", "draw_no", key.alias("key")), held)
    first = free.groupBy("key").agg(F.min_by(F.struct("slot", "lo", "hi"), "draw_no").alias("_pick"))
    return accept(first.select("_pick.*", "key"))


def roomy_draws(
    waiting: DataFrame, held: DataFrame, length: int, seed: int, round_no: int, draws: int
) -> DataFrame:
    """Draws of a round whose slot has a gap that is long enough."""
    ranges = waiting.select(*RANGE).distinct()
    if ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        space = FreeSpace(ranges, held, length)
        gaps = space.gaps
        waiting = waiting.join(F.broadcast(space.widest()), RANGE).where(F.col("n") <= F.col("widest")).drop("widest")
    else:
        gaps = materialize(touched_gaps(held, length), "touched")
    drawn = draw_slots(waiting, length, seed, round_no, draws)
    widest = gaps.groupBy("block", "slot").agg(F.greatest(F.max(gap_size()), F.lit(0)).cast("int").alias("_room"))
    if gaps.where("last").count() <= ROOM_SLOTS:
        drawn = drawn.withColumn("_block", int_div(F.col("slot"), BLOCK_SLOTS))
        met = drawn.join(F.broadcast(rooms(widest, length)), "_block", "left")
        met = met.withColumn("_room", F.get("_rooms", (F.col("slot") % BLOCK_SLOTS).cast("int"))).drop("_block", "_rooms")
    else:
        met = drawn.join(widest.drop("block"), "slot", "left")
    return met.where(F.col("n") <= F.coalesce("_room", F.lit(length))).drop("_room")  # without a room: nothing is held


def rooms(widest: DataFrame, length: int) -> DataFrame:
    """``(_block, _rooms)``: the longest gap of every slot of a block, up to the last one in which something is held."""
    cell = F.struct((F.col("slot") % BLOCK_SLOTS).cast("int").alias("at"), "_room")
    listed = widest.groupBy("block").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    gap_end = lambda i: F.when(i > 0, F.get("cells", i - 1)["at"]).otherwise(F.lit(-1))
    filled = F.transform(
        "cells", lambda c, i: F.concat(F.array_repeat(F.lit(length), c["at"] - gap_end(i) - 1), F.array(c["_room"]))
    )
    return listed.select(F.col("block").alias("_block"), F.flatten(filled).alias("_rooms"))


RANGE = ["start", "end_excl"]


def touched_gaps(held: DataFrame, length: int) -> DataFrame:
    """Free intervals ``(block, slot, lo, hi, last)`` of the slots in which something is held.

    Every slot has one row more than held intervals, ``last`` marks the last one; empty gaps have ``hi < lo``.
    """
    step = F.lit(length).cast("bigint")
    end = (F.col("slot") + 1) * step
    ends = held.select("slot").distinct().select("slot", end.alias("lo"), end.alias("hi"))
    edges = ends.unionByName(held.select("slot", "lo", "hi"))
    before = Window.partitionBy("slot").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before), F.col("slot") * step - 1)
    block = int_div(F.col("slot"), BLOCK_SLOTS)
    return edges.select(
        block.alias("block"), "slot", (reach + 1).alias("lo"), (F.col("lo") - 1).alias("hi"), (F.col("lo") == end).alias("last")
    )


def range_blocks(ranges: DataFrame, length: int) -> DataFrame:
    """Blocks ``(start, end_excl, block, first, end)`` of each range with the slots they share with it.

    Blocks are listed by way of blocks of blocks, so no array is longer than ``BLOCK_SLOTS`` unless a
    range has more than ``BLOCK_SLOTS ** 3`` slots.
    """
    step = F.lit(length).cast("bigint")
    first, end = int_div(F.col("start"), step), int_div(F.col("end_excl"), step)
    big = F.lit(BLOCK_SLOTS).cast("bigint") * BLOCK_SLOTS
    large = ranges.select(*RANGE, first.alias("_first"), end.alias("_end")).withColumn(
        "_big", F.explode(F.sequence(int_div(F.col("_first"), big), int_div(F.col("_end") - 1, big)))
    )
    low = int_div(F.greatest("_first", F.col("_big") * big), BLOCK_SLOTS)
    high = int_div(F.least("_end", (F.col("_big") + 1) * big) - 1, BLOCK_SLOTS)
    blocks = large.withColumn("block", F.explode(F.sequence(low, high)))
    return blocks.select(
        *RANGE,
        "block",
        F.greatest("_first", F.col("block") * BLOCK_SLOTS).alias("first"),
        F.least("_end", (F.col("block") + 1) * BLOCK_SLOTS).alias("end"),
    )


def gap_size() -> Column:
    return F.col("hi") - F.col("lo") + 1


class FreeSpace:
    """What is free in some ranges, counted per block: ``blocks`` and the gaps of touched slots."""

    def __init__(self, ranges: DataFrame, held: DataFrame | None, length: int):
        self.length = length
        nothing = ranges.sparkSession.createDataFrame([], "block bigint, slot bigint, lo bigint, hi bigint, last boolean")
        self.gaps = nothing if held is None else materialize(touched_gaps(held, length), "touched")
        listed = range_blocks(ranges, length)
        inside = self.within(listed)
        seen = inside.groupBy(*RANGE, "block").agg(F.count_if("last").alias("_touched"), F.max(gap_size()).alias("_widest"))
        untouched = F.col("end") - F.col("first") - F.coalesce("_touched", F.lit(0))
        joined = listed.join(seen, [*RANGE, "block"], "left").withColumn("untouched", untouched)
        widest = F.when(F.col("untouched") > 0, F.lit(length)).otherwise(F.coalesce("_widest", F.lit(0)))
        counted = joined.select(*RANGE, "block", "first", "end", "untouched", widest.cast("bigint").alias("widest"))
        self.blocks = materialize(counted, "free")

    def within(self, blocks: DataFrame) -> DataFrame:
        """Gaps of touched slots with the blocks of ranges they lie in."""
        return blocks.join(self.gaps, "block").where((F.col("slot") >= F.col("first")) & (F.col("slot") < F.col("end")))

    def widest(self) -> DataFrame:
        """``start, end_excl, widest``: the longest gap of each range."""
        return self.blocks.groupBy(*RANGE).agg(F.max("widest").alias("widest"))

    def cells(self, asked: DataFrame) -> DataFrame:
        """The first ``wanted`` cells ``(start, end_excl, _rank, at)`` of size ``cell`` for ``asked(start, end_excl, cell, wanted)``."""
        blocks = self.blocks.join(asked, RANGE)
        whole = int_div(F.lit(self.length).cast("bigint"), F.col("cell"))
        fitting = F.sum(int_div(gap_size(), F.col("cell"))).alias("_fitting")
        cut = self.within(blocks).where(gap_size() >= F.col("cell")).groupBy(*RANGE, "block").agg(fitting)
        room = F.col("untouched") * whole + F.coalesce("_fitting", F.lit(0))
        counted = blocks.join(cut, [*RANGE, "block"], "left").withColumn("room", room).where("room > 0").drop("_fitting")
        summed = ordered_scan(counted, [*RANGE, "block"], sum_before={"_sum": F.col("room")})
        base = summed.groupBy(*RANGE).agg(F.min("_sum").alias("_base"))
        before = (F.col("_sum") - F.col("_base")).alias("before")
        columns = [*RANGE, "block", "first", "end", "cell", "wanted"]
        chosen = materialize(summed.join(base, RANGE).select(*columns, before).where("before < wanted"), "chosen")
        names = [*RANGE, "block", "cell", "wanted", "before", "lo", "hi"]
        slots = chosen.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("end") - 1)))
        lo = F.col("slot") * F.lit(self.length).cast("bigint")
        open_slots = slots.join(self.gaps.select("slot").distinct(), "slot", "left_anti").withColumns(
            {"lo": lo, "hi": lo + self.length - 1}
        )
        entries = open_slots.select(*names).unionByName(self.within(chosen).where(gap_size() >= F.col("cell")).select(*names))
        held = entries.withColumn("n", int_div(gap_size(), F.col("cell")))
        ahead = Window.partitionBy(*RANGE, "block").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0))
        reached = held.withColumn("_first", first).where("_first < wanted")
        each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n", F.col("wanted") - F.col("_first")) - 1))
        return reached.withColumn("_at", each).select(
            *RANGE, (F.col("_first") + F.col("_at")).alias("_rank"), (F.col("lo") + F.col("_at") * F.col("cell")).alias("at")
        )


def play_gaps(waiting: DataFrame, held: DataFrame | None, length: int) -> DataFrame:
    """Rows ``(KEY, slot, lo, hi)`` for waiting candidates put into gaps; none if no candidate fits."""
    space = FreeSpace(waiting.select(*RANGE).distinct(), held, length)
    fits = spread_join(waiting, space.widest(), RANGE, KEY).where(F.col("n") <= F.col("widest"))
    fits = materialize(fits.drop("widest"), "fits")
    asked = fits.groupBy(*RANGE).agg(F.max("n").cast("bigint").alias("cell"), F.count(F.lit(1)).alias("wanted"))
    cells = space.cells(materialize(asked, "asked"))
    ranked = grouped_ordinal(fits.withColumn("_size", -F.col("n")), RANGE, ["_size", *KEY], "_rank")
    met = ranked.join(cells, [*RANGE, "_rank"]).select(
        int_div(F.col("at"), F.lit(length).cast("bigint")).alias("slot"),
        F.col("at").alias("lo"),
        (F.col("at") + F.col("n") - 1).alias("hi"),
        F.struct(*KEY).alias("key"),
    )
    return accept(met)  # ranges that overlap may have met in a gap


def place_random(
    candidates: DataFrame,
    length: int,
    seed: int,
    occupied: DataFrame | None = None,
    max_rounds: int = ROUNDS,
    few: int | None = FEW,
) -> Placement:
    """Place ``candidates(exp_id, copy_no, seq_id, n, start, end_excl)`` without overlap.

    Every candidate is placed unless it is longer than every gap that is left in its range.
    Gaps are filled once at most one candidate in ``few`` waits; without ``few``, all candidates draw in all rounds.
    Only counts reach the driver.  Every round is one folder of a stage table; it is
    both the growing occupied set and the input of the next round.
    """
    spark = candidates.sparkSession
    narrow = candidates.select(*KEY, F.col("n").cast("int").alias("n"), "start", "end_excl")
    waiting = materialize(narrow.repartition(*KEY), "candidates")  # ids and sizes only
    faults = range_violations(waiting, length).first().asDict()
    left = n_all = faults.pop("n_rows")
    if any(faults.values()):
        raise PlacementError(f"candidates break the placement rules: {faults}")
    initial, n_held = None, 0
    if occupied is not None:
        initial = materialize(by_slot(occupied, length), "occupied")
        n_held = initial.count()
    base = new_path(spark, "rounds")
    paths: list[str] = []

    def log() -> DataFrame:
        if not paths:
            return spark.createDataFrame([], ROUND_SCHEMA + ", round int")
        return spark.read.schema(ROUND_SCHEMA + ", round int").option("basePath", base).parquet(*paths)

    def placed() -> DataFrame:
        return log().where("slot is not null")

    moved, drawing = True, max_rounds > 0
    while left and moved:
        round_no = len(paths)
        held = initial if n_held else None
        if paths:
            earlier = placed().select("slot", "lo", "hi")
            held = earlier if initial is None else earlier.unionByName(initial)
        if drawing:
            draws = draws_in(round_no)
            crowded = left * draws > n_held
            if n_held > PRUNE_ABOVE and not crowded:
                slots = draw_positions(waiting, length, seed, round_no, draws).select("slot").distinct()
                held = held.join(slots, "slot", "left_semi")
            won = play_round(waiting, held, length, seed, round_no, draws, crowded)
        else:
            won = play_gaps(waiting, held, length)
        path = f"{base}/round={round_no}"
        waiting.join(won, KEY, "left").select(*[c.split()[0] for c in ROUND_SCHEMA.split(", ")]).write.parquet(path)
        paths.append(path)
        waiting = spark.read.schema(ROUND_SCHEMA).parquet(path).where("slot is null").select(*waiting.columns)
        before, left = left, waiting.count()
        moved = drawing or before > left
        drawing = drawing and len(paths) < max_rounds and (few is None or left * few > n_all)
        n_held += before - left
    waits = log().where("slot is null").groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_waits"))
    return Placement(placed().select(*KEY, "n", "lo", "hi", "round"), waiting.select(*KEY, "n"), waits, len(paths))


def merge_plans(writes: DataFrame, order_col: str = "write_seq") -> DataFrame:
    """Last write wins on equal ``position``; equal keys are merged before the shuffle."""
    others = [c for c in writes.columns if c not in ("position", order_col)]
    last = F.max_by(F.struct(*others), F.col(order_col)).alias("_last")
    return writes.groupBy("position").agg(last).select("position", "_last.*")
