"""The token corpus: packing, order, shards, and applying a plan to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inlay.functions.tokens import int_div, left_pad, pad_mask
from inlay.operators.scan import ordered_scan

HOT_TOKENS = 1 << 20  # inserted tokens of an index above which they are merged before they are shuffled
BROADCAST_SHARDS = 500_000  # checked before broadcasting: three numbers per bucketed shard row


def pack_sequences(docs: DataFrame, length: int, id_col: str = "doc_id", eos: int | None = None) -> DataFrame:
    """Concatenate ``docs(id, tokens)`` in id order and cut every ``length`` tokens.

    The scan for the start offsets carries only id and size; the tokens move twice,
    to meet their offset and to meet their sequence.  The last sequence may be short.
    """
    if eos is not None:
        docs = docs.withColumn("tokens", F.concat("tokens", F.array(F.lit(eos))))
    step = F.lit(length).cast("bigint")
    sizes = docs.select(id_col, F.size("tokens").cast("bigint").alias("n"))
    starts = ordered_scan(sizes, [id_col], sum_before={"start": F.col("n")}).where("n > 0")
    end = F.col("start") + F.col("n")
    placed = docs.join(starts, id_col).withColumn(
        "index", F.explode(F.sequence(int_div(F.col("start"), step), int_div(end - 1, step)))
    )
    low = F.greatest("start", F.col("index") * step)
    high = F.least(end, (F.col("index") + 1) * step)
    piece = F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    pieces = placed.select("index", F.struct(low.alias("at"), piece.alias("part")).alias("piece"))
    grouped = pieces.groupBy("index").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return grouped.select("index", F.flatten(F.transform("pieces", lambda p: p["part"])).alias("tokens"))


def patches(index_map: DataFrame) -> DataFrame:
    """One sparse overlay per index: ``patch`` holds a token or null for every local position.

    Where insertions overlap the one with the larger ordinal wins; :func:`_top_tokens` makes that choice
    per token.  An index whose insertions lie apart is put together from whole insertions instead, unless
    it has more than ``HOT_TOKENS`` tokens of them; one aggregate looks for such indices, of which there are few.
    """
    held = index_map.where(F.size("tokens") > 0).select("index", "ordinal", "pos", "tokens")
    large = held.groupBy("index").agg(F.sum(F.size("tokens")).alias("_n")).where(F.col("_n") > HOT_TOKENS).select("index")
    found = large.collect()
    if not found:
        return _gathered_patches(held)
    hot = F.broadcast(held.sparkSession.createDataFrame(found, large.schema))
    same = F.col("index").eqNullSafe(F.col("_hot"))
    hot = hot.withColumnRenamed("index", "_hot")
    merged = _joined_pieces(_top_tokens(held.join(hot, same, "left_semi")))
    return _gathered_patches(held.join(hot, same, "left_anti")).unionByName(merged)


def _gathered_patches(held: DataFrame) -> DataFrame:
    """:func:`patches` of rows that may be gathered by index: one shuffle, and tokens move in their lists."""
    before = Window.partitionBy("index").orderBy("pos", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    met = F.coalesce(F.max(F.col("pos") + F.size("tokens")).over(before) > F.col("pos"), F.lit(False))
    marked = held.withColumn("_met", met).withColumn("_any", F.max("_met").over(Window.partitionBy("index")))
    apart = marked.where(~F.col("_any")).select("index", "pos", "tokens")
    return _joined_pieces(apart).unionByName(_joined_pieces(_top_tokens(marked.where("_any"))))


def _top_tokens(rows: DataFrame) -> DataFrame:
    """Pieces ``(index, pos, tokens)`` of one token: that of the largest ordinal at its position.

    The choice is made in a partial aggregate, so an index with any number of
    insertions shrinks to at most one row per position.
    """
    spots = rows.select("index", "ordinal", "pos", F.posexplode("tokens").alias("_at", "token"))
    cell = F.max(F.struct("ordinal", "token"))["token"].alias("token")
    cells = spots.groupBy("index", (F.col("pos") + F.col("_at")).alias("off")).agg(cell)
    return cells.select("index", F.col("off").alias("pos"), F.array("token").alias("tokens"))


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    """``(index, patch)`` of disjoint pieces ``(index, pos, tokens)``, with nulls in between."""
    listed = pieces.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("pieces"))
    last = lambda i: F.get("pieces", i - 1)
    end = lambda i: F.when(i > 0, last(i)["pos"] + F.size(last(i)["tokens"])).otherwise(F.lit(0))
    filled = F.transform(
        "pieces", lambda p, i: F.concat(F.array_repeat(F.lit(None).cast("int"), p["pos"] - end(i)), p["tokens"])
    )
    return listed.select("index", F.flatten(filled).alias("patch"))


def _with_reason(sequences: DataFrame, index_map: DataFrame) -> DataFrame:
    sizes = sequences.select("index", F.size("tokens").alias("_held"))
    reason = F.when(F.col("_held").isNull(), F.lit("no sequence")).when(
        F.col("pos") + F.size("tokens") > F.col("_held"), F.lit("behind the end")
    )
    return index_map.join(sizes, "index", "left").withColumn("reason", reason).drop("_held")


def beyond_corpus(sequences: DataFrame, index_map: DataFrame) -> DataFrame:
    """Map rows that cannot be written: no such sequence, or tokens behind its end (``reason``)."""
    return _with_reason(sequences, index_map).where("reason is not null")


def within_corpus(sequences: DataFrame, index_map: DataFrame) -> DataFrame:
    """Map rows that can be written; together with :func:`beyond_corpus` all of them."""
    return _with_reason(sequences, index_map).where("reason is null").drop("reason")


def overlay(sequences: DataFrame, index_map: DataFrame) -> DataFrame:
    """``sequences(index, tokens)`` with the plan's tokens written over them, lengths unchanged.

    Sequences without insertions pass through where they are; only the others move.  A
    map row that cannot be written fails the job; :func:`beyond_corpus` lists such rows.
    """
    plan = patches(index_map)
    touched = index_map.where(F.size("tokens") > 0).select("index").distinct()
    untouched = sequences.join(touched, "index", "left_anti")
    joined = sequences.join(touched, "index", "left_semi").join(plan, "index", "right")
    message = F.concat(F.lit("the plan goes beyond the corpus at sequence "), F.col("index"))
    unfit = F.col("tokens").isNull() | (F.size("patch") > F.size("tokens"))
    merged = F.zip_with("tokens", F.slice("patch", F.lit(1), F.size("tokens")), lambda t, p: F.coalesce(p, t))
    tokens = F.when(unfit, F.raise_error(message).cast("array<int>")).otherwise(merged)
    written = joined.withColumn("tokens", tokens).select(*sequences.columns)
    return untouched.unionByName(written)


def read_back(sequences: DataFrame, index_map: DataFrame) -> DataFrame:
    """Map rows with the tokens found at their place in ``sequences`` (``found``)."""
    joined = index_map.join(sequences.select("index", F.col("tokens").alias("_seq")), "index")
    found = F.slice("_seq", F.col("pos") + 1, F.size("tokens"))
    return joined.withColumn("found", found).drop("_seq")


def resolve_instances(index_map: DataFrame, order: DataFrame) -> DataFrame:
    """Map rows re-addressed to corpus instances; an index outside the order fails the job."""
    named = order.select(F.col("seq_idx").alias("index"), "instance_id")
    joined = index_map.join(named, "index", "left")
    missing = F.concat(F.lit("no instance for sequence "), F.col("index"))
    checked = F.when(F.col("instance_id").isNull(), F.raise_error(missing).cast("bigint")).otherwise(
        F.col("instance_id")
    )
    return joined.withColumn("instance_id", checked).select("instance_id", "index", "ordinal", "pos", "tokens")


def locate_in_shards(ids: DataFrame, shards: DataFrame, id_col: str = "instance_id") -> DataFrame:
    """Add ``shard_id`` and ``local_index`` from ``shards(shard_id, first, last_excl)``.

    Shards are cut into buckets of the mean shard size, so the range lookup is an
    equi-join on the bucket with a range check behind it and the bucketed shard list
    stays below twice the number of shards.  Negative ids count from the end; an id
    out of range fails the job.
    """
    span = shards.agg(
        F.coalesce(F.max("last_excl"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("shards")
    ).first()
    total = span["n"]
    width = F.lit(max(1, -(-total // max(1, span["shards"])))).cast("bigint")
    bucketed = shards.where("last_excl > first").select(
        "shard_id",
        "first",
        "last_excl",
        F.explode(F.sequence(int_div(F.col("first"), width), int_div(F.col("last_excl") - 1, width))).alias("_b"),
    )
    if span["shards"] <= BROADCAST_SHARDS:
        bucketed = F.broadcast(bucketed)
    raw = F.col(id_col)
    at = F.when(raw < 0, raw + F.lit(total)).otherwise(raw)
    asked = ids.withColumn("_at", at).withColumn("_b", int_div(F.col("_at"), width))
    inside = (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("last_excl"))
    met = asked.alias("a").join(bucketed.alias("s"), (F.col("a._b") == F.col("s._b")) & inside, "left")
    message = F.concat(raw, F.lit(f" is out of bounds for {total} instances"))
    shard = F.when(F.col("shard_id").isNull(), F.raise_error(message).cast("bigint")).otherwise(F.col("shard_id"))
    return met.select(
        *[F.col(f"a.{c}") for c in ids.columns],
        shard.cast("bigint").alias("shard_id"),
        (F.col("_at") - F.col("first")).alias("local_index"),
    )


def batch_instances(order: DataFrame, shards: DataFrame, batch: int | None = None) -> DataFrame:
    """Instances of one training batch (or of all) with shard and place, in training order."""
    rows = order if batch is None else order.where(F.col("batch") == batch)
    return locate_in_shards(rows.select("batch", "seq_idx", "instance_id"), shards)


def pad_batches(rows: DataFrame, id_col: str, batch: int, pad: int) -> DataFrame:
    """Fixed-size batches of token lists, padded on the left to the longest of the batch."""
    ranked = ordered_scan(rows.select(id_col, "tokens"), [id_col], ordinal="_n")
    numbered = ranked.withColumn("batch", int_div(F.col("_n"), batch))
    width: Column = F.max(F.size("tokens")).over(Window.partitionBy("batch"))  # ``batch`` rows each
    sized = numbered.withColumn("width", width)
    return sized.select(
        "batch",
        id_col,
        left_pad(F.col("tokens"), F.col("width"), pad).alias("padded"),
        pad_mask(F.col("tokens"), F.col("width")).alias("mask"),
    )
