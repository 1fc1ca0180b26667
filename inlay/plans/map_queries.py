"""Queries over the stored index map, the corpus, and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.functions.tokens import int_div
from inlay.geometry import Geometry
from inlay.operators import corpus, index_map, permutation, reindex, sampling
from inlay.plans.catalog import joined, query
from inlay.plans.placement_queries import (
    CHUNK,
    FLAT,
    NESTED,
    ORDER_END,
    REINDEX,
    TWO_PHASE,
    nested_text,
    reindex_sql,
    two_phase,
)
from inlay.plans.views import BATCH, EOS, LENGTH, SEED, Tables, with_views
from inlay.sources import metric_files, records, token_shards
from inlay.staging import materialize, new_path

EXPERIMENTS = 5  # of the fixed plan

# -- stored index map ------------------------------------------------------------------


def stored_map(t: Tables) -> index_map.IndexMap:
    """The re-indexed plan written as a fresh map."""
    store = index_map.IndexMap(t.spark, new_path(t.spark, "map"))
    store.overwrite(reindex.reindex(t.plan, CHUNK))
    return store


def appended_map(t: Tables) -> index_map.IndexMap:
    """Experiments 0 to 2 as a fresh map, the others appended; the append runs twice to show it is safe."""
    store = index_map.IndexMap(t.spark, new_path(t.spark, "map"))
    store.overwrite(reindex.reindex(t.plan.where("exp_id <= 2"), CHUNK))
    more = reindex.reindex(t.plan.where("exp_id > 2"), CHUNK)
    for _ in range(2):
        store.append(more, ["ordinal"], "later")
    return store


APPENDED = (
    REINDEX.format(c=CHUNK, src="(select * from v_plan where exp_id<=2)").replace("pieces", "p1").replace("imap", "m1")
    + ", "
    + REINDEX.format(c=CHUNK, src="(select * from v_plan where exp_id>2)").replace("pieces", "p2").replace("imap", "m2")
    + ", imap as (select * from m1 union all select index, ordinal + coalesce(held, 0), pos, tokens from m2 left join"
    " (select index, count(*) held from m1 group by index) using (index))"
)


@query("map_write_overwrite", reindex_sql(FLAT))
def map_write_overwrite(t: Tables) -> DataFrame:
    return stored_map(t).rows().withColumn("tokens", joined("tokens"))


@query("map_append", with_views(FLAT, "v_plan", extra=APPENDED))
def map_append(t: Tables) -> DataFrame:
    return appended_map(t).rows().withColumn("tokens", joined("tokens"))


ONE_BY_ONE = (
    REINDEX.format(c=CHUNK, src="(select * from v_plan where exp_id = -1)")
    + "".join(
        ", " + REINDEX.format(c=CHUNK, src=f"(select * from v_plan where exp_id={n})").replace("pieces", f"q{n}").replace("imap", f"n{n}")
        for n in range(EXPERIMENTS)
    )
    + ", every as ("
    + " union all ".join(f"select {n} turn, * from n{n}" for n in range(EXPERIMENTS))
    + ")"
)


@query(
    "map_append_each",
    with_views(
        "select index, row_number() over (partition by index order by turn, ordinal) - 1 ordinal, pos,"
        " array_to_string(tokens, ',') tokens from every",
        "v_plan",
        extra=ONE_BY_ONE,
    ),
)
def map_append_each(t: Tables) -> DataFrame:
    """Every experiment appended by itself; each append reads the counters of the indices it reaches."""
    store = index_map.IndexMap(t.spark, new_path(t.spark, "map"))
    for n in range(EXPERIMENTS):
        store.append(reindex.reindex(t.plan.where(F.col("exp_id") == n), CHUNK), ["ordinal"], f"experiment {n}")
    return store.rows().withColumn("tokens", joined("tokens"))


@query("map_read_nested", with_views(NESTED, "v_plan", extra=APPENDED))
def map_read_nested(t: Tables) -> DataFrame:
    return nested_text(appended_map(t).nested())


@query("map_indices", reindex_sql("select distinct index, count(distinct index) over () n from (select distinct index from imap)"))
def map_indices(t: Tables) -> DataFrame:
    held = stored_map(t).indices()
    return held.withColumn("n", F.lit(held.count()).cast("bigint"))


PROBES = "probes as (select distinct l_orderkey*64//{c} as index from lineitem)".format(c=CHUNK)


def probes(t: Tables) -> DataFrame:
    return t.table("lineitem").select(int_div(F.col("l_orderkey") * 64, CHUNK).alias("index"))


@query(
    "map_has_index",
    with_views(
        "select index, index in (select index from imap) has from probes",
        "v_plan",
        extra=REINDEX.format(c=CHUNK, src="v_plan") + ", " + PROBES,
    ),
)
def map_has_index(t: Tables) -> DataFrame:
    return stored_map(t).has_index(probes(t))


@query(
    "map_lookup",
    with_views(
        "select index, ordinal, pos, array_to_string(tokens, ',') tokens from probes left join imap using (index)",
        "v_plan",
        extra=REINDEX.format(c=CHUNK, src="v_plan") + ", " + PROBES,
    ),
)
def map_lookup(t: Tables) -> DataFrame:
    return stored_map(t).lookup(probes(t)).withColumn("tokens", joined("tokens"))


@query(
    "map_point_lookup",
    with_views(
        "select index, ordinal, pos, array_to_string(tokens, ',') tokens from (select distinct spot//{c} as index from (select"
        " o_orderkey*64 + o_custkey%2*1000000000 spot from orders order by o_totalprice desc, o_orderkey limit 10)) left join"
        " imap using (index)".format(c=CHUNK),
        "v_plan",
        extra=REINDEX.format(c=CHUNK, src="v_plan"),
    ),
)
def map_point_lookup(t: Tables) -> DataFrame:
    """Indices of the ten dearest orders, some of them absent, from the files that the zone table names."""
    store = stored_map(t)
    store.note_files()
    dearest = t.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    spot = F.expr("o_orderkey*64 + o_custkey%2*1000000000")
    return store.lookup(dearest.select(int_div(spot, CHUNK).alias("index"))).withColumn("tokens", joined("tokens"))


@query(
    "map_overlaps",
    with_views(
        "select index, ordinal, pos from (select *, max(pos+len(tokens)-1) over (partition by index order by pos,"
        " pos+len(tokens)-1, ordinal rows between unbounded preceding and 1 preceding) reach from twice where"
        " len(tokens)>0) where reach >= pos",
        "v_plan",
        extra=REINDEX.format(c=CHUNK, src="v_plan")
        + ", twice as (select index, ordinal, pos, tokens from imap union all select index, (row_number() over"
        " (partition by index order by ordinal) - 1) + (select count(*) from imap i where i.index=s.index), pos, tokens"
        " from imap s where pos % 2 = 0)",
    ),
)
def map_overlaps(t: Tables) -> DataFrame:
    """Half of the map appended a second time: every repeated row meets its first copy."""
    store = stored_map(t)
    again = reindex.reindex(t.plan, CHUNK).where("pos % 2 = 0")
    store.append(again, ["ordinal"], "again")
    return store.overlaps()


# -- offset arrays -----------------------------------------------------------------------

CSR = (
    ", k as (select index, row_number() over (order by index) - 1 k_ord, count(*) n from imap group by index),"
    " tt as (select *, row_number() over (order by index, ordinal) - 1 t_ord from imap)"
)


def csr_sql(body: str) -> str:
    return with_views(body, "v_plan", extra=REINDEX.format(c=CHUNK, src="v_plan") + CSR)


def offset_arrays(t: Tables) -> index_map.OffsetArrays:
    return index_map.to_offset_arrays(stored_map(t).rows())


@query("csr_keys", csr_sql('select k_ord, index as "key" from k'))
def csr_keys(t: Tables) -> DataFrame:
    return offset_arrays(t).keys


@query(
    "csr_tuple_offsets",
    csr_sql(
        "select k_ord, (sum(n) over (order by k_ord) - n)::BIGINT off from k union all select count(*), sum(n)::BIGINT from k"
    ),
)
def csr_tuple_offsets(t: Tables) -> DataFrame:
    return offset_arrays(t).tuple_offsets


@query(
    "csr_token_offsets",
    csr_sql(
        "select t_ord, (sum(len(tokens)) over (order by t_ord) - len(tokens))::BIGINT off from tt union all"
        " select count(*), sum(len(tokens))::BIGINT from tt"
    ),
)
def csr_token_offsets(t: Tables) -> DataFrame:
    return offset_arrays(t).token_offsets


@query("csr_decode", reindex_sql(FLAT))
def csr_decode(t: Tables) -> DataFrame:
    """Stored as five tables, read back, decoded."""
    path = new_path(t.spark, "offsets")
    offset_arrays(t).write(path)
    rows = index_map.from_offset_arrays(index_map.OffsetArrays.read(t.spark, path))
    return rows.withColumn("tokens", joined("tokens"))


@query(
    "period_snapshot",
    with_views(
        f"select position//{BATCH * LENGTH * 10} as period, position, array_to_string(tokens, ',') tokens from v_plan",
        "v_plan",
    ),
)
def period_snapshot(t: Tables) -> DataFrame:
    """Plan snapshots per period by two micro-batches, the first of which runs again."""
    from inlay.streaming.control import read_periods

    return read_periods(t.spark, saved_periods(t, None)).select("period", "position", joined("tokens").alias("tokens"))


def saved_periods(t: Tables, resolve) -> str:
    from inlay.streaming.control import save_periods

    plan = t.plan.select(
        F.col("position").alias("seq_id"),
        "position",
        "tokens",
        int_div(F.col("position"), BATCH * LENGTH * 10).alias("period"),
    )
    path = new_path(t.spark, "periods")
    for batch_id, share in ((0, 0), (1, 1), (0, 0)):
        save_periods(plan.where(F.col("period") % 2 == share), path, batch_id, resolve)
    return path


# -- corpus ----------------------------------------------------------------------------------

PACKED = (
    "stream as (select token, row_number() over (order by doc_id, at_) - 1 g from (select doc_id, unnest(tokens) token,"
    f" generate_subscripts(tokens, 1) as at_ from v_doc_tokens)), packed as (select g//{LENGTH} as index, list(token order"
    " by g) tokens from stream group by 1)"
)


def packed(t: Tables) -> DataFrame:
    return corpus.pack_sequences(t.doc_tokens, LENGTH)


@query(
    "pack_sequences",
    with_views("select index, array_to_string(tokens, ',') tokens from packed", "v_doc_tokens", extra=PACKED),
)
def pack_sequences(t: Tables) -> DataFrame:
    return packed(t).select("index", joined("tokens").alias("tokens"))


@query(
    "overlay_sequences",
    with_views(
        "select p.index, string_agg(coalesce(c.token, p.token)::VARCHAR, ',' order by p.off) tokens from (select index,"
        " unnest(tokens) token, generate_subscripts(tokens, 1) - 1 off from packed) p left join (select index,"
        " pos + generate_subscripts(tokens, 1) - 1 off, unnest(tokens) token from imap join (select index, len(tokens) held from"
        " packed) using (index) where pos + len(tokens) <= held) c on c.index=p.index and c.off=p.off group by p.index",
        "v_doc_tokens",
        "v_plan",
        extra=PACKED + ", " + REINDEX.format(c=LENGTH, src="v_plan"),
    ),
)
def overlay_sequences(t: Tables) -> DataFrame:
    """The plan written over the packed documents; ``overlay_beyond`` has its rows behind their end."""
    sequences = materialize(packed(t), "packed")
    rows = materialize(corpus.within_corpus(sequences, reindex.reindex(t.plan, LENGTH)), "rows")
    return corpus.overlay(sequences, rows).select("index", joined("tokens").alias("tokens"))


@query(
    "overlay_beyond",
    with_views(
        "select index, ordinal, pos, len(tokens) n, if(held is null, 'no sequence', 'behind the end') reason from imap left"
        " join (select index, len(tokens) held from packed) using (index) where held is null or pos + len(tokens) > held",
        "v_doc_tokens",
        "v_plan",
        extra=PACKED + ", " + REINDEX.format(c=LENGTH, src="v_plan"),
    ),
)
def overlay_beyond(t: Tables) -> DataFrame:
    """Rows of the plan that the packed documents have no place for, and why."""
    rows = corpus.beyond_corpus(packed(t), reindex.reindex(t.plan, LENGTH))
    return rows.select("index", "ordinal", "pos", F.size("tokens").cast("bigint").alias("n"), "reason")


ORDERED = (
    "ordered as (select o_orderkey instance_id, row_number() over (order by ('0x'||substr(md5(concat_ws(':',{s},0,"
    "o_orderkey)),1,15))::BIGINT, o_orderkey) - 1 seq_idx from orders)"
).format(s=SEED)


def order_of(t: Tables) -> DataFrame:
    return sampling.train_order(t.table("orders"), "o_orderkey", SEED, 0, BATCH)


@query(
    "resolve_instances",
    with_views(
        "select instance_id, index, ordinal, pos, array_to_string(tokens, ',') tokens from imap join ordered on"
        " seq_idx=index",
        "v_plan",
        extra=REINDEX.format(c=LENGTH, src="v_plan") + ", " + ORDERED,
    ),
)
def resolve_instances(t: Tables) -> DataFrame:
    resolved = corpus.resolve_instances(reindex.reindex(t.plan, LENGTH), order_of(t))
    return resolved.withColumn("tokens", joined("tokens"))


def permuted_sql(source: str) -> str:
    """``permuted(seq_idx, instance_id)`` of the numbers in ``source``: turns until a number is below ``n``."""
    turns = ["x // b r0", "x % b c0"]
    for k in range(permutation.TURNS):
        own, other, size = ("r", "c", "a") if k % 2 == 0 else ("c", "r", "b")
        hashed = f"('0x'||substr(md5(concat_ws(':',{SEED},'turn',{k},{other}{k})),1,15))::BIGINT"
        turns += [f"({own}{k}+{hashed})%{size} {own}{k + 1}", f"{other}{k} {other}{k + 1}"]
    turned = ", ".join(turns) + f", r{permutation.TURNS}*b+c{permutation.TURNS} y"
    cells = (
        "cells as (select n, a, (n+a-1)//a b from (select n, ceil(sqrt(n))::BIGINT a from (select count(*) n from orders)))"
    )
    return (
        f"{cells}, walked as (select seq_idx, y x, n from (select seq_idx, n, {turned} from (select seq_idx, seq_idx x"
        f" from {source}), cells) union all select seq_idx, y, n from (select seq_idx, cells.n, {turned} from walked, cells"
        " where x >= cells.n)), permuted as (select seq_idx, x instance_id from walked where x < n)"
    )


def permuted(t: Tables) -> permutation.Permutation:
    return permutation.permutation(t.spark, t.table("orders").count(), SEED)


@query(
    "permuted_order",
    with_views(
        "select seq_idx, instance_id, seq_idx back from permuted",
        extra=permuted_sql("(select row_number() over () - 1 seq_idx from orders)"),
        recursive=True,
    ),
)
def permuted_order(t: Tables) -> DataFrame:
    """A computed order of all instances, and the way back from an instance to its place."""
    order = permuted(t)
    rows = t.spark.range(order.n).select(F.col("id").alias("seq_idx"), order.instance_of(F.col("id")).alias("instance_id"))
    return rows.withColumn("back", order.sequence_of(F.col("instance_id")))


@query(
    "resolve_permuted",
    with_views(
        "select instance_id, index, ordinal, pos, array_to_string(tokens, ',') tokens from imap join permuted on"
        " seq_idx=index",
        "v_plan",
        extra=REINDEX.format(c=LENGTH, src="v_plan") + ", " + permuted_sql("(select distinct index seq_idx from imap)"),
        recursive=True,
    ),
)
def resolve_permuted(t: Tables) -> DataFrame:
    resolved = permutation.resolve_permuted(reindex.reindex(t.plan, LENGTH), permuted(t))
    return resolved.withColumn("tokens", joined("tokens"))


HALVES = ", ".join(
    REINDEX.format(c=LENGTH, src=f"(select * from v_plan where position//{BATCH * LENGTH * 10}%2={share})")
    .replace("pieces", f"p{share}")
    .replace("imap", f"m{share}")
    for share in (0, 1)
)


@query(
    "period_snapshot_resolved",
    with_views(
        f"select index//{BATCH * 10} as period, instance_id, index, ordinal, pos, array_to_string(tokens, ',') tokens from"
        " halves join permuted on seq_idx=index",
        "v_plan",
        extra=HALVES
        + ", halves as (select index, ordinal, pos, tokens from m0 union all select index, ordinal, pos, tokens from m1), "
        + permuted_sql("(select distinct index seq_idx from halves)"),
        recursive=True,
    ),
)
def period_snapshot_resolved(t: Tables) -> DataFrame:
    """The same snapshots in their second form, as rows of corpus instances."""
    from inlay.streaming.control import read_resolved, resolver

    path = saved_periods(t, resolver(Geometry(LENGTH, BATCH), 10, permuted(t)))
    rows = read_resolved(t.spark, path)
    return rows.select("period", "instance_id", "index", "ordinal", "pos", joined("tokens").alias("tokens"))


SIGNED = (
    "ids as (select l_linenumber, l_partkey, if(l_linenumber%2=0, l_orderkey, l_orderkey-(select count(*) from orders))"
    " instance_id from lineitem)"
)


@query(
    "instance_to_shard",
    with_views(
        "select l_linenumber, l_partkey, instance_id, shard_id, at_ - first local_index from (select *, if(instance_id<0,"
        " instance_id+(select count(*) from orders), instance_id) at_ from ids) join v_shards on first <= at_ and at_ <"
        " last_excl",
        "v_shards",
        extra=SIGNED,
    ),
)
def instance_to_shard(t: Tables) -> DataFrame:
    orders = t.table("orders").count()
    ids = t.table("lineitem").selectExpr(
        "l_linenumber", "l_partkey", f"if(l_linenumber%2=0, l_orderkey, l_orderkey-{orders}) instance_id"
    )
    return corpus.locate_in_shards(ids, t.shards)


@query(
    "batch_instances",
    with_views(
        f"select seq_idx//{BATCH} batch, seq_idx, instance_id, shard_id, instance_id-first local_index from ordered join"
        " v_shards on first <= instance_id and instance_id < last_excl",
        "v_shards",
        extra=ORDERED,
    ),
)
def batch_instances(t: Tables) -> DataFrame:
    return corpus.batch_instances(order_of(t), t.shards)


@query(
    "pad_batches",
    with_views(
        "select batch, doc_id, array_to_string(list_concat(list_resize([]::INTEGER[], w-len(tokens), 0), tokens), ',')"
        " padded, array_to_string(list_concat(list_resize([]::INTEGER[], w-len(tokens), 0), list_resize([]::INTEGER[],"
        " len(tokens), 1)), ',') mask from (select *, max(len(tokens)) over (partition by batch) w from (select doc_id,"
        " tokens, (row_number() over (order by doc_id) - 1)//16 batch from v_doc_tokens))",
        "v_doc_tokens",
    ),
)
def pad_batches(t: Tables) -> DataFrame:
    rows = corpus.pad_batches(t.doc_tokens, "doc_id", 16, 0)
    return rows.select("batch", "doc_id", joined("padded").alias("padded"), joined("mask").alias("mask"))


@query(
    "overlay_read_back",
    with_views(
        "select index, ordinal, pos, array_to_string(tokens, ',') tokens, true same from imap",
        "v_plan",
        "v_insert_tokens",
        "v_doc_tokens",
        extra=TWO_PHASE
        + ", corpus as (select ceil(sum(len(tokens))/{L})::BIGINT n from v_doc_tokens), ".format(L=LENGTH)
        + REINDEX.format(c=LENGTH, src=f"(select position, tokens from plan where position//{LENGTH} < (select n-1 from corpus)"
        f" and (position+len(tokens)-1)//{LENGTH} < (select n-1 from corpus))"),
        recursive=True,
    ),
)
def overlay_read_back(t: Tables) -> DataFrame:
    """Flagship: pack the documents, plan in two phases, write the plan over them, read every row back.

    The planned range is longer than the packed corpus; rows behind its last full
    sequence have nothing to overwrite.
    """
    sequences = materialize(packed(t), "packed")
    full = sequences.count() - 1
    plan = two_phase(t).placements
    inside = plan.where((F.col("position") + F.size("tokens") - 1 < full * LENGTH))
    rows = materialize(reindex.reindex(inside, LENGTH), "rows")
    back = corpus.read_back(corpus.overlay(sequences, rows), rows)
    return back.select(
        "index", "ordinal", "pos", joined("tokens").alias("tokens"), (F.col("found") == F.col("tokens")).alias("same")
    )


# -- file sources and sinks ----------------------------------------------------------------------


def lines_file(t: Tables, rows: DataFrame, order_by: str, line: str) -> str:
    """``rows`` written as lines in ``order_by`` order."""
    path = new_path(t.spark, "lines")
    rows.repartitionByRange(order_by).sortWithinPartitions(order_by).selectExpr(f"{line} value").write.text(path)
    return path


@query("jsonl_roundtrip", "select doc_id, text, lang, source, n_chars from documents")
def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = new_path(t.spark, "jsonl")
    docs = t.table("documents").select("doc_id", "text", "lang", "source", "n_chars")
    records.write_jsonl(docs, path)
    return records.read_jsonl(t.spark, path, docs.schema.simpleString()[len("struct<") : -1].replace(":", " "))


@query("src_jsonl", "select conv_id, turn, text from conversations")
def src_jsonl(t: Tables) -> DataFrame:
    """Only the declared fields are read; blank lines in between are skipped."""
    line = "concat(to_json(struct(conv_id, turn, role, text)), if(turn = 0, '\\n\\n', ''))"
    path = lines_file(t, t.table("conversations"), "conv_id", line)
    return records.read_jsonl(t.spark, path, "conv_id bigint, turn bigint, text string")


@query(
    "src_flexible_sequences",
    with_views(
        "select 'text' kind, doc_id seq_id, text content from documents union all select 'tokens', doc_id,"
        " array_to_string(tokens, ',') from v_doc_tokens",
        "v_doc_tokens",
    ),
)
def src_flexible_sequences(t: Tables) -> DataFrame:
    """Bare values on even rows, objects on odd ones, for texts and for token lists."""
    docs = t.table("documents").select("doc_id", "text")
    bare = "regexp_extract(to_json(array({0})), '(?s)^.(.*).$', 1)"
    mixed = "if(doc_id % 2 = 0, " + bare + ", to_json(struct({0} as content)))"
    texts = records.read_sequences(t.spark, lines_file(t, docs, "doc_id", mixed.format("text")), "text", "content")
    tokens = records.read_sequences(
        t.spark, lines_file(t, t.doc_tokens, "doc_id", mixed.format("tokens")), "tokens", "content"
    )
    both = texts.select(F.lit("text").alias("kind"), "seq_id", F.col("text").alias("content"))
    return both.unionByName(tokens.select(F.lit("tokens").alias("kind"), "seq_id", joined("tokens").alias("content")))


@query(
    "src_positioned",
    with_views(
        "select row_number() over (order by position) - 1 seq_id, position, array_to_string(tokens, ',') tokens from v_plan",
        "v_plan",
    ),
)
def src_positioned(t: Tables) -> DataFrame:
    path = lines_file(t, t.plan, "position", "to_json(struct(tokens, position as pos))")
    rows = records.read_positioned(t.spark, path, "tokens", "tokens", "pos")
    return rows.select("seq_id", "position", joined("tokens").alias("tokens"))


@query("prj_fields", with_views("select exp_id, array_to_string(tokens, ',') tokens, position from v_plan", "v_plan"))
def prj_fields(t: Tables) -> DataFrame:
    rows = t.plan.withColumnRenamed("position", "pos")
    return records.project_fields(rows, "tokens", "pos").withColumn("tokens", joined("tokens"))


FILES = (
    "files as (select event_type task_name, event_id%16 part, count(*) primary_score, (sum(event_id%7))::BIGINT acc_char"
    " from events group by all)"
)


def metric_folder(t: Tables) -> str:
    """One metric file per event type and 16th of the events, plus an unreadable one per type."""
    path = new_path(t.spark, "metrics")
    counted = t.table("events").groupBy("event_type", (F.col("event_id") % 16).alias("part")).agg(
        F.count(F.lit(1)).alias("primary_score"), F.sum(F.col("event_id") % 7).alias("acc_char")
    )
    body = F.to_json(
        F.struct(
            F.col("event_type").alias("task_name"),
            F.struct("primary_score", "acc_char", F.col("event_type").alias("note")).alias("metrics"),
        )
    )
    good = counted.select("event_type", "part", body.alias("value"))
    broken = counted.select("event_type").distinct().select("event_type", F.lit(99).alias("part"), F.lit("{").alias("value"))
    good.unionByName(broken).repartition("event_type", "part").write.partitionBy("event_type", "part").text(path)
    return path


@query(
    "src_metric_files",
    with_views(
        "select task_name, primary_score::DOUBLE primary_score, acc_char::DOUBLE acc_char from files", extra=FILES
    ),
)
def src_metric_files(t: Tables) -> DataFrame:
    files = metric_files.read_metric_files(t.spark, metric_folder(t), "part-*")
    parsed = F.from_json("metrics", "primary_score double, acc_char double")
    return files.select("task_name", parsed.alias("m")).select("task_name", "m.*")


def shard_folder(t: Tables) -> str:
    rest = F.array_repeat(F.lit(EOS), LENGTH - F.size("tokens"))
    full = packed(t).withColumn("tokens", F.concat("tokens", rest))
    path = new_path(t.spark, "shards")
    token_shards.write_shards(full, path, 16)
    return path


@query(
    "src_token_shards",
    with_views(
        "select index//16 shard_id, index%16 local_index, index instance_id, array_to_string(tokens, ',') tokens from"
        f" (select index, list_concat(tokens, list_resize([]::INTEGER[], {LENGTH}-len(tokens), {EOS})) tokens from packed)",
        "v_doc_tokens",
        extra=PACKED,
    ),
)
def src_token_shards(t: Tables) -> DataFrame:
    """Packed documents (last sequence filled up with EOS) written as binary shards and scanned back."""
    rows = token_shards.read_shards(t.spark, shard_folder(t), LENGTH)
    return rows.withColumn("tokens", joined("tokens"))


@query(
    "src_shard_ranges",
    with_views(
        "select index//16 shard_id, index%16 local_index, index instance_id, array_to_string(tokens, ',') tokens from"
        f" (select index, list_concat(tokens, list_resize([]::INTEGER[], {LENGTH}-len(tokens), {EOS})) tokens from packed)"
        " where index in (3, 4, 40) or index >= 64",
        "v_doc_tokens",
        extra=PACKED,
    ),
)
def src_shard_ranges(t: Tables) -> DataFrame:
    """A few instances and an open end, of which only the bytes are read."""
    rows = token_shards.read_shards(t.spark, shard_folder(t), LENGTH, instances=[3, 4, 40, (64, 1 << 62)])
    return rows.withColumn("tokens", joined("tokens"))
