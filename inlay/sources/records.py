"""JSON-lines sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inlay.staging import materialize

KINDS = {"text": "string", "tokens": "array<int>"}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines in file order: ``(seq_id, line)`` with a dense ``seq_id``."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    # numbers run on inside a part, and a part reads a block in one go: only counts of blocks are put in order
    kept = lines.where(F.trim("line") != "").withColumn("_line", F.monotonically_increasing_id())
    staged = materialize(kept, "lines", compression="zstd")
    block = ["_file", "_block"]
    counted = staged.groupBy(*block).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carry = materialize(counted, "blocks").select(
        *block, "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before")
    )
    numbered = staged.join(F.broadcast(carry), block)
    return numbered.select((F.col("_before") + F.col("_line") - F.col("_first")).alias("seq_id"), "line")


def _field(kind: str, value: Column, path: str) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind!r}")
    return F.variant_get(value, path, KINDS[kind])


def _required(value: Column, key: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"record without {key!r}")))


def sequences_of(lines: DataFrame, kind: str, key: str | None = None) -> DataFrame:
    """Lines holding a bare value, or an object with the value under ``key``."""
    parsed = lines.withColumn("_v", F.parse_json("line"))
    value = _field(kind, F.col("_v"), "$")
    if key is not None:
        is_object = F.schema_of_variant("_v").startswith("OBJECT")
        value = F.when(is_object, _field(kind, F.col("_v"), f"$.{key}")).otherwise(
            F.when(~is_object, _field(kind, F.col("_v"), "$"))
        )
    return parsed.select("seq_id", _required(value, key or "value").alias(kind))


def read_sequences(spark: SparkSession, path: str, kind: str, key: str | None = None) -> DataFrame:
    """``(seq_id, text | tokens)``; the kind is declared, not guessed from the first row."""
    return sequences_of(read_lines(spark, path), kind, key)


def positioned_of(lines: DataFrame, kind: str, key: str | None, position_key: str = "position") -> DataFrame:
    """Lines as ``(seq_id, text | tokens, position)``."""
    if key is None:
        if kind == "tokens":
            raise ValueError("token records at explicit positions need a key")
        key = "text"
    parsed = lines.withColumn("_v", F.parse_json("line"))
    return parsed.select(
        "seq_id",
        _required(_field(kind, F.col("_v"), f"$.{key}"), key).alias(kind),
        _required(F.variant_get("_v", f"$.{position_key}", "bigint"), position_key).alias("position"),
    )


def read_positioned(
    spark: SparkSession, path: str, kind: str, key: str | None = None, position_key: str = "position"
) -> DataFrame:
    return positioned_of(read_lines(spark, path), kind, key, position_key)


def project_fields(records: DataFrame, key: str, position_key: str | None = None) -> DataFrame:
    """The content field and the position field of structured records; a missing value is an error."""
    out = [_required(F.col(key), key).alias(key)]
    if position_key:
        out.append(_required(F.col(position_key), position_key).cast("bigint").alias("position"))
    kept = [c for c in records.columns if c not in (key, position_key)]
    return records.select(*kept, *out)


def control_prompts(prompts: DataFrame) -> DataFrame:
    """Prompt rows that carry a text."""
    return prompts.where(F.col("text").isNotNull())


def pair_responses(queries: DataFrame, responses: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Queries with their response, joined by id (never by row order)."""
    return queries.join(responses, id_col)
