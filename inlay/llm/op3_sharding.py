"""Shards by jump consistent hashing, in built-in functions only.

The shard is a function of the key and of the number of shards; with one more shard a
key stays or moves to the new one.  A null key counts as 0.  Null and empty texts have
one byte of size.  Repeated rows share a shard and get slots of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import partitions, ranked, table

# Fixed value: multiplier of the generator of the published algorithm.
MULTIPLIER = 2862933555777941757
SHARDS = 8
ROWS_PER_PART = 500_000  # rows that are numbered by one window group, on average
LOW = 0xFFFFFFFF


def next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of ``key * MULTIPLIER + 1`` modulo 2**64, without overflow of a bigint."""
    m3, m2, m1, m0 = ((MULTIPLIER >> s) & 0xFFFF for s in (48, 32, 16, 0))

    def bits(value: Column, mask: int) -> Column:
        return value.bitwiseAND(F.lit(mask).cast("bigint"))

    p0, p1 = low * m0, low * m1
    below = bits(p0, LOW) + F.shiftleft(bits(p1, 0xFFFF), 16) + 1
    carry = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(below, 32)
    above = carry + F.shiftleft(bits(high * m1, 0xFFFF), 16) + high * m0 + F.shiftleft(bits(low * m3, 0xFFFF), 16) + low * m2
    return bits(above, LOW), bits(below, LOW)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a bigint key among ``shards``.

    A step leads to a later shard, so ``shards`` steps always end the walk and about
    their logarithm usually do; only the rows that need more take the long walk.
    """
    if not 1 <= shards <= 1 << 30:
        raise ValueError("shards must lie between 1 and 2**30")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(LOW).cast("bigint")).alias("low"),
        F.lit(-1).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("next"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = next_key(s["high"], s["low"])
        jump = (s["next"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(
            high.alias("high"), low.alias("low"), s["next"].alias("at"), F.floor(jump).cast("bigint").alias("next")
        )
        return F.when(s["next"] < shards, moved).otherwise(s)

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    short = min(shards, 8 + 2 * math.ceil(math.log2(shards) + 1))
    state = walk(start, short)
    if short < shards:
        state = F.get(
            F.transform(F.array(state), lambda s: F.when(s["next"] < shards, walk(s, shards)).otherwise(s)), F.lit(0)
        )
    return state["at"].cast("int")


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as ``(key, size, text_crc32, shard, slot, grown_shard)``; slots have no gaps."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    parts = max(partitions(docs.sparkSession), math.ceil(docs.select(key).count() / ROWS_PER_PART))
    return ranked(narrow, ["shard"], [key, "size", "text_crc32"], "slot", parts)




def crc(blob: str) -> str:
    """CRC-32 of a blob in DuckDB, by the table ``t`` of all byte values."""
    return f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(
    regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""


SQL = f"""
with recursive crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
bodies as (select doc_id, (strlen(coalesce("text", '')) + 1)::bigint as size, encode(coalesce("text", '')) as body from documents),
texts as (select doc_id, size, {crc('body')} as text_crc32 from bodies, crc_table),
hashed as (select *, {crc("encode(concat_ws(' ', doc_id, size, text_crc32))")} as order_crc,
  (coalesce(doc_id, 0)::hugeint + 18446744073709551616) % 18446744073709551616 as k from texts, crc_table),
walk(doc_id, size, text_crc32, order_crc, shards, k, at_shard, nxt) as (
  select doc_id, size, text_crc32, order_crc, shards, k, -1::bigint, 0::bigint
  from hashed, (values ({SHARDS}), ({SHARDS + 1})) s(shards)
  union all
  select doc_id, size, text_crc32, order_crc, shards, k2, nxt,
    floor((nxt + 1)::double * (2147483648.0::double / ((k2 // 8589934592) + 1)::double))::bigint
  from (select *, (((k // 4294967296) * {MULTIPLIER} % 4294967296) * 4294967296 + (k % 4294967296) * {MULTIPLIER} + 1)
    % 18446744073709551616 as k2 from walk where nxt < shards)),
ended as (select doc_id, size, text_crc32, order_crc, max(at_shard) filter (shards = {SHARDS})::int as shard,
  max(at_shard) filter (shards = {SHARDS + 1})::int as grown_shard from walk where nxt >= shards group by all)
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard,
  (row_number() over (partition by shard order by order_crc, doc_id, size, text_crc32))::bigint - 1 as slot from ended"""


@queries.query("op3_sharding", SQL)
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    out = shard_rows(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
