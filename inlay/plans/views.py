"""Inputs for the registered queries: frames derived from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.functions.tokenizers import hashed_words, word_tokens
from inlay.operators.scan import grouped_ordinal
from inlay.operators.skew import spread_join
from inlay.staging import materialize

LENGTH = 256  # tokens per sequence
BATCH = 8  # sequences per batch
EOS = 0
SEED = 42


def balanced(scan: DataFrame, key: str) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has slots, ahead of CPU-heavy work per row.

    A table of many files already has more splits than slots and stays as it is.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots, key) if scan.rdd.getNumPartitions() < slots else scan


class Tables:
    """The tables of one data folder and the views built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return balanced(self.table("documents").select("doc_id", "text"), "doc_id")

    @cached_property
    def doc_tokens(self) -> DataFrame:
        """The tokenised documents, stored once: a filter on token counts would otherwise tokenise again below it."""
        return materialize(self.documents.select("doc_id", hashed_words("text").alias("tokens")), "tokens")

    @property
    def insert_tokens(self) -> DataFrame:
        return self.table("benchmark").select(
            F.col("item_id").alias("seq_id"), word_tokens(F.col("text")).alias("tokens")
        )

    @property
    def plan(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey*64 + o_custkey%32 position",
            "transform(sequence(1, cast(1+o_custkey%24 as int)), i -> cast(o_orderkey%1000 as int)*32+i) tokens",
            "cast(o_custkey%5 as int) exp_id",
        )

    @property
    def occupied(self) -> DataFrame:
        return self.plan.selectExpr("position lo", "position+size(tokens)-1 hi")

    @cached_property
    def numbered_lines(self) -> DataFrame:
        """Line items with their number inside the order, also when one order holds most lines."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
        )
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        return grouped_ordinal(lines, ["l_orderkey"], order, "_n").withColumn("rn", F.col("_n") + 1)

    @property
    def candidates(self) -> DataFrame:
        return self.numbered_lines.selectExpr(
            "l_orderkey*100+rn cand_id",
            "l_orderkey*64+l_partkey%64 lo",
            "l_orderkey*64+l_partkey%64+cast(l_quantity as bigint)%16 hi",
        )

    @cached_property
    def choices(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_name")
        parts = parts.withColumnRenamed("p_partkey", "l_partkey")
        lines = spread_join(self.numbered_lines, parts, ["l_partkey"], ["l_orderkey", "rn"])
        return lines.selectExpr(
            "l_orderkey doc_id",
            "cast(rn-1 as int) idx",
            "cast(l_orderkey%4 as int) label",
            "array(cast(l_orderkey%1000 as int),7,cast(l_partkey%3 as int),cast(l_suppkey as int)) token_ids",
            "array(cast(null as double),-0.5D,-l_discount,-l_tax) logprobs",
            "if(l_orderkey%2=0,'char','none') norm",
            "p_name continuation",
        )

    @property
    def prompts_scored(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey query_id",
            "array(cast(o_custkey%50 as int), cast(o_custkey%7 as int), 3) token_ids",
            "array(cast(null as double), -(o_custkey%50)/100D, -(o_custkey%7)/10D) logprobs",
        )

    @property
    def math(self) -> DataFrame:
        return self.numbered_lines.selectExpr(
            "l_orderkey*100+rn query_id",
            "cast(l_linenumber as int) ops",
            "cast(l_quantity%23 as int) answer",
            "case l_partkey%5 when 0 then concat('so Answer: ',cast(l_quantity%23 as int),' done') "
            "when 1 then concat('Answer: ',cast(l_suppkey%23 as int),'\\nAnswer: 4') when 2 then 'no result' "
            "when 3 then concat('Answer: ',cast(l_quantity%23 as int)) else 'Answer: x' end response",
        )

    @property
    def memorize(self) -> DataFrame:
        return self.doc_tokens.selectExpr(
            "doc_id",
            "tokens token_ids",
            "case when doc_id%3=0 then slice(tokens,26,25) when doc_id%3=1 then slice(tokens,26,24) "
            "else slice(tokens,1,25) end generated",
        )

    @property
    def dialog(self) -> DataFrame:
        turns = self.table("conversations")
        asked = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text prompt")
        told = turns.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 turn", "text generation")
        return asked.join(told, ["conv_id", "turn"])

    @property
    def knowledge(self) -> DataFrame:
        """Dialog turns as knowledge queries: the target is the end of the prompt or the start of the reply."""
        words = "filter(split(generation, '[ \\\\n\\\\t\\\\r]+'), w -> w != '')"
        asked = "filter(split(prompt, '[ \\\\n\\\\t\\\\r]+'), w -> w != '')"
        return self.dialog.selectExpr(
            "conv_id * 100 + turn query_id",
            "prompt input",
            f"concat(' ', if(conv_id % 2 = 0, array_join(slice({words}, 1, 3), ' '), array_join(slice({asked}, 1, 2), ' ')), ' ') target",
            "generation",
            f"size({asked}) input_tokens",
            f"concat(array(cast(null as double)), transform(sequence(1, size({asked}) + 2), i -> -(i % 7) / 10D)) logprobs",
        )

    @property
    def generations(self) -> DataFrame:
        """Per conversation: the first user turn as prompt, every reply as one generation.

        Generation 1 of every third conversation repeats the prompt after a lead-in.
        """
        turns = self.table("conversations")
        first = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
        told = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"))
        replies = grouped_ordinal(told, ["conv_id"], ["turn"], "_n").select(
            "conv_id", (F.col("_n") + 1).cast("int").alias("gen"), "reply"
        )
        copied = F.when(
            (F.col("conv_id") % 3 == 0) & (F.col("gen") == 1 + F.col("conv_id") % 2), F.concat(F.lit("well, "), "prompt")
        ).otherwise(F.col("reply"))
        return spread_join(replies, first, ["conv_id"], ["gen"]).select(
            F.col("conv_id").alias("prompt_id"), "gen", "prompt", copied.alias("generation")
        )

    @property
    def metric_files(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id",
            "event_type task_name",
            "concat('{\"primary_score\":', event_id%100, ',\"acc_char\":', event_id%7, ',\"note\":\"', event_type, '\"}') metrics",
        )

    @property
    def embed(self) -> DataFrame:
        return self.table("embeddings").selectExpr("vec_id", "vec_id div 8 batch", "embedding")

    @property
    def control(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_type experiment",
            "event_id div 100 step",
            "event_id prompt_id",
            "concat('evt ',user_id,' ',event_type) text",
            "value",
        )

    @property
    def shards(self) -> DataFrame:
        """Uneven shards over the orders: one per supplier."""
        suppliers = self.table("supplier")
        n = suppliers.count()
        return suppliers.selectExpr(
            "s_suppkey shard_id",
            "s_suppkey*150 + if(s_suppkey = 0, 0, s_suppkey*37%100) first",
            f"(s_suppkey+1)*150 + if(s_suppkey = {n} - 1, 0, (s_suppkey+1)*37%100) last_excl",
        )


_WORDS = "list_filter(regexp_split_to_array({0},'[ \\n\\t\\r]+'), lambda x: x != '')"
_TOKENS = (
    "list_transform(" + _WORDS + ", lambda x: (('0x'||substr(md5(x),1,7))::BIGINT+1)::INTEGER)"
)
_NUMBERED = (
    "(select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,"
    " l_extendedprice) rn from lineitem)"
)

# name -> (DuckDB SQL, views it needs)
SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_doc_tokens": (f"select doc_id, {_TOKENS.format('text')} tokens from documents", ()),
    "v_insert_tokens": (f"select item_id seq_id, {_TOKENS.format('text')} tokens from benchmark", ()),
    "v_plan": (
        "select o_orderkey*64 + o_custkey%32 as position, list_transform(range(1, 2+o_custkey%24),"
        " lambda i: ((o_orderkey%1000)*32+i)::INTEGER) tokens, (o_custkey%5)::INTEGER exp_id from orders",
        (),
    ),
    "v_occupied": ("select position lo, position+len(tokens)-1 hi from v_plan", ("v_plan",)),
    "v_candidates": (
        "select l_orderkey*100+rn cand_id, l_orderkey*64+l_partkey%64 lo,"
        f" l_orderkey*64+l_partkey%64+(l_quantity::BIGINT)%16 hi from {_NUMBERED} t",
        (),
    ),
    "v_choices": (
        "select l_orderkey doc_id, (rn-1)::INTEGER idx, (l_orderkey%4)::INTEGER as label,"
        " [(l_orderkey%1000)::INTEGER,7,(l_partkey%3)::INTEGER,l_suppkey::INTEGER] token_ids,"
        " [null::DOUBLE,-0.5::DOUBLE,-l_discount,-l_tax] logprobs,"
        f" if(l_orderkey%2=0,'char','none') norm, p_name continuation from {_NUMBERED} t join part on l_partkey=p_partkey",
        (),
    ),
    "v_prompts_scored": (
        "select o_orderkey query_id, [(o_custkey%50)::INTEGER,(o_custkey%7)::INTEGER,3] token_ids,"
        " [null::DOUBLE, -(o_custkey%50)/100.0::DOUBLE, -(o_custkey%7)/10.0::DOUBLE] logprobs from orders",
        (),
    ),
    "v_math": (
        "select l_orderkey*100+rn query_id, l_linenumber::INTEGER ops, (l_quantity%23)::INTEGER answer,"
        " case l_partkey%5 when 0 then concat('so Answer: ',(l_quantity%23)::INTEGER,' done')"
        " when 1 then concat('Answer: ',(l_suppkey%23)::INTEGER,chr(10)||'Answer: 4') when 2 then 'no result'"
        f" when 3 then concat('Answer: ',(l_quantity%23)::INTEGER) else 'Answer: x' end response from {_NUMBERED} t",
        (),
    ),
    "v_memorize": (
        "select doc_id, tokens token_ids, case when doc_id%3=0 then tokens[26:50] when doc_id%3=1 then tokens[26:49]"
        " else tokens[1:25] end generated from v_doc_tokens",
        ("v_doc_tokens",),
    ),
    "v_dialog": (
        "select u.conv_id, u.turn, u.text prompt, a.text generation from conversations u join conversations a"
        " on a.conv_id=u.conv_id and a.turn=u.turn+1 where u.role='user' and a.role='assistant'",
        (),
    ),
    "v_knowledge": (
        "select conv_id*100+turn query_id, prompt as input, ' ' || if(conv_id%2=0,"
        f" array_to_string(({_WORDS.format('generation')})[1:3], ' '),"
        f" array_to_string(({_WORDS.format('prompt')})[1:2], ' ')) || ' ' target, generation,"
        f" len({_WORDS.format('prompt')}) input_tokens,"
        " list_concat([null::DOUBLE], list_transform(range(1, len("
        f"{_WORDS.format('prompt')})+3), lambda i: -(i%7)/10.0::DOUBLE)) logprobs from v_dialog",
        ("v_dialog",),
    ),
    "v_generations": (
        "select r.conv_id prompt_id, r.gen, p.prompt, if(r.conv_id%3=0 and r.gen=1+r.conv_id%2, 'well, '||p.prompt,"
        " r.reply) generation from (select conv_id, (row_number() over (partition by conv_id order by turn))::INTEGER gen,"
        " text reply from conversations where role='assistant') r join (select conv_id, min_by(text, turn) prompt"
        " from conversations where role='user' group by conv_id) p on p.conv_id=r.conv_id",
        (),
    ),
    "v_metric_files": (
        "select event_id, event_type task_name, concat('{\"primary_score\":', event_id%100, ',\"acc_char\":',"
        " event_id%7, ',\"note\":\"', event_type, '\"}') metrics from events",
        (),
    ),
    "v_metric_rows": (
        "select event_id, task_name, metric, json_extract_string(metrics, '$.'||metric) mval,"
        " json_type(metrics, '$.'||metric) kind from (select *, unnest(json_keys(metrics)) metric from v_metric_files)",
        ("v_metric_files",),
    ),
    "v_embed": ("select vec_id, vec_id // 8 batch, embedding from embeddings", ()),
    "v_control": (
        "select event_type experiment, event_id // 100 step, event_id prompt_id,"
        " concat('evt ',user_id,' ',event_type) \"text\", value from events",
        (),
    ),
    "v_shards": (
        "select s_suppkey shard_id, s_suppkey*150 + if(s_suppkey=0,0,s_suppkey*37%100) as first,"
        " (s_suppkey+1)*150 + if(s_suppkey=(select count(*) from supplier)-1,0,(s_suppkey+1)*37%100) last_excl"
        " from supplier",
        (),
    ),
}


def with_views(body: str, *names: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` preceded by the views it uses (and ``extra`` common table expressions)."""
    seen: list[str] = []

    def need(name: str) -> None:
        for dep in SQL_VIEWS[name][1]:
            need(dep)
        if name not in seen:
            seen.append(name)

    for name in names:
        need(name)
    parts = [f"{name} as ({SQL_VIEWS[name][0]})" for name in seen]
    if extra:
        parts.append(extra)
    head = "with recursive " if recursive else "with "
    return (head + ", ".join(parts) + " " if parts else "") + body
