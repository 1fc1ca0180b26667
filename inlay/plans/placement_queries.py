"""Queries over intervals, sampling, wrapping, placement and re-indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from inlay.functions.tokenizers import CodepointTokenizer, codepoint_tokens, plugin_texts, plugin_tokens, vocabulary_tokens, word_tokens, words
from inlay.functions.tokens import int_div, wrap_eos
from inlay.geometry import Geometry
from inlay.operators import intervals, placement, reindex, sampling
from inlay.plans import experiments
from inlay.plans.catalog import joined, query, rounded
from inlay.plans.views import BATCH, EOS, LENGTH, SEED, SQL_VIEWS, Tables, with_views

GEOMETRY = Geometry(LENGTH, BATCH)
WRAP_SQL = (
    "case when len(tokens) >= {L} then tokens else (case when len(c) < {L} and c[1] != {E}"
    " then list_prepend({E}, c) else c end) end"
).format(L=LENGTH, E=EOS)


def wrapped_sql(source: str, columns: str) -> str:
    """Rows of ``source`` that pass the length gate, wrapped in EOS."""
    return (
        f"(select {columns}, ({WRAP_SQL})::INTEGER[] tokens from (select *, case when tokens[-1] = {EOS}"
        f" then tokens else list_append(tokens, {EOS}) end c from {source}"
        f" where len(tokens) between 1 and {LENGTH}))"
    )


def draw_sql(seed, exp, copy, seq, rnd, tag: str, draw_no="0") -> str:
    text = f"concat_ws(':',{seed},{exp},{copy},{seq},{rnd},{draw_no},'{tag}')"
    return f"('0x'||substr(md5({text}),1,15))::BIGINT"


def rounds_sql(candidates: str, occupied: str | None, seed: int = SEED, few: int | None = placement.FEW) -> str:
    """Common table expressions that replay the placement rounds and the filling of gaps; the result is ``placed``."""
    key = "exp_id, copy_no, seq_id"
    head, taken = "", ""
    if occupied:
        head = (
            f"occ as (select slot, greatest(lo, slot*{LENGTH}) lo, least(hi, slot*{LENGTH}+{LENGTH}-1) hi from"
            f" (select *, unnest(range(lo//{LENGTH}, hi//{LENGTH}+1)) slot from ({occupied}))), "
        )
        taken = " union all select slot, lo, hi from occ"
    names = ("exp_id", "copy_no", "seq_id", "r+1")
    slot = f"st//{LENGTH} + {draw_sql(seed, *names, 's', 'd')} % ((en-st)//{LENGTH})"
    offset = f"{draw_sql(seed, *names, 'o', 'd')} % ({LENGTH}-n+1)"
    order = f"partition by slot order by lo, hi, {key}"
    # first of each chain of touching intervals
    accepted = (
        f"c1 as (select *, max(hi) over ({order} rows between unbounded preceding and 1 preceding) reach from {{rows}}),"
        f" c2 as (select *, sum(case when reach>=lo then 0 else 1 end) over ({order} rows between unbounded preceding"
        " and current row) chain from c1),"
        f" won as (select {key}, slot, lo, hi from (select *, row_number() over (partition by slot, chain order by"
        f" {key}) w from c2) where w=1)"
    )
    # one draw in each of the rounds 0 to 5, then twice as many each round, 32 at most
    draws = "least(32, 1 << greatest(0, r + 1 - 5))"
    enough = "" if few is None else f" and (select {few} * count(*) filter (not placed) > count(*) from rounds)"
    return (
        f"{head}rounds as (select -1 r, exp_id, copy_no, seq_id, n::BIGINT n, st::BIGINT st, en::BIGINT en,"
        f" null::BIGINT slot, null::BIGINT lo, null::BIGINT hi, false placed from ({candidates}) union all ("
        f" with w0 as (select * from rounds where not placed and r < {placement.ROUNDS - 1}{enough}),"
        f" d0 as (select r, {key}, n, st, en, unnest(range({draws})) d from w0),"
        f" d1 as (select *, {slot} slot, {offset} off from d0),"
        f" d2 as (select r, {key}, d, slot, slot*{LENGTH}+off lo, slot*{LENGTH}+off+n-1 hi from d1),"
        f" held as (select slot, lo, hi from rounds where placed{taken}),"
        f" free as (select *, row_number() over (partition by {key} order by d) pick from d2 where not exists"
        " (select 1 from held h where h.slot=d2.slot and h.lo<=d2.hi and d2.lo<=h.hi)),"
        f" {accepted.format(rows='free where pick=1')}"
        f" select r+1, {key}, n, st, en, won.slot, won.lo, won.hi, won.slot is not null from w0 left join"
        f" won using ({key}) union all select r+1, {key}, n, st, en, slot, lo, hi, placed from rounds where placed and exists"
        " (select 1 from w0))),"
        f" gapped as (select 0 r, {key}, n, st, en, slot, lo, hi, placed, true more from rounds where r = (select max(r) from"
        " rounds) union all ("
        " with w as (select * from gapped where not placed and more),"
        f" sl as (select st, en, unnest(range(st//{LENGTH}, en//{LENGTH})) slot from (select distinct st, en from w)),"
        f" held as (select slot, lo, hi from gapped where placed{taken}),"
        f" edges as (select distinct slot, slot*{LENGTH}+{LENGTH} lo, slot*{LENGTH}+{LENGTH} hi from sl union all"
        " select slot, lo, hi from held where slot in (select slot from sl)),"
        f" gp as (select slot, coalesce(max(hi) over (partition by slot order by lo, hi rows between unbounded preceding and"
        f" 1 preceding), slot*{LENGTH}-1)+1 lo, lo-1 hi from edges),"
        " gr as (select st, en, lo, hi from sl join gp using (slot) where lo <= hi),"
        " fit as (select w.* from w join (select st, en, max(hi-lo+1) widest from gr group by all) using (st, en)"
        " where n <= widest),"
        " cells as (select st, en, spot, row_number() over (partition by st, en order by spot) k from (select st, en,"
        " unnest(range(lo, hi-cell+2, cell)) spot from gr join (select st, en, max(n) cell from fit group by all) using"
        " (st, en) where hi-lo+1 >= cell)),"
        f" ranked as (select *, row_number() over (partition by st, en order by n desc, {key}) k from fit),"
        f" met as (select {key}, spot//{LENGTH} slot, spot lo, spot+n-1 hi from (select r.exp_id, r.copy_no, r.seq_id, r.n,"
        " c.spot from ranked r join cells c using (st, en, k))),"
        f" {accepted.format(rows='met')}"
        f" select r+1, {key}, n, st, en, won.slot, won.lo, won.hi, won.slot is not null, (select count(*) > 0 from won) from w"
        f" left join won using ({key}) union all select r+1, {key}, n, st, en, slot, lo, hi, placed, (select count(*) > 0"
        " from won) from gapped where placed and exists (select 1 from w))),"
        " placed as (select * from gapped where placed and r = (select max(r) from gapped))"
    )


# -- scalar projections ------------------------------------------------------------


@query("tokenize_words", with_views("select doc_id, array_to_string(tokens, ',') tokens from v_doc_tokens", "v_doc_tokens"))
def tokenize_words(t: Tables) -> DataFrame:
    docs = t.documents
    return docs.select("doc_id", joined(word_tokens(F.col("text"))).alias("tokens"))


@query(
    "tokenize_codepoints",
    "select doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',') tokens"
    " from documents",
)
def tokenize_codepoints(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", joined(codepoint_tokens(F.col("text"))).alias("tokens"))


@query(
    "plugin_tokenize",
    "select doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: unicode(c)), ',') tokens, length(text) n"
    " from documents",
)
def plugin_tokenize(t: Tables) -> DataFrame:
    """Documents through the tokenizer plug-in."""
    encode = plugin_tokens(CodepointTokenizer)
    rows = t.documents.select("doc_id", encode(F.col("text")).alias("tokens"))
    return rows.select("doc_id", joined("tokens").alias("tokens"), F.size("tokens").cast("bigint").alias("n"))


@query("decode_tokens", "select doc_id, text from documents")
def decode_tokens(t: Tables) -> DataFrame:
    """Encoded and decoded again by the plug-in."""
    encode, decode = plugin_tokens(CodepointTokenizer), plugin_texts(CodepointTokenizer)
    return t.documents.select("doc_id", decode(encode(F.col("text"))).alias("text"))


_SPLIT = "list_filter(regexp_split_to_array(text,'[ \\n\\t\\r]+'), lambda x: x != '')"


@query(
    "tokenize_vocabulary",
    f"with w as (select distinct unnest({_SPLIT}) word from benchmark),"
    " v as (select word, (row_number() over (order by word))::INTEGER token from w),"
    f" s as (select doc_id, unnest({_SPLIT}) word, generate_subscripts({_SPLIT}, 1) as at_ from documents)"
    " select doc_id, string_agg(coalesce(token, 0)::VARCHAR, ',' order by at_) tokens from s left join v using (word)"
    " group by doc_id",
)
def tokenize_vocabulary(t: Tables) -> DataFrame:
    from inlay.operators.scan import ordered_scan

    known = t.table("benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    ranked = ordered_scan(known, ["word"], ordinal="n")
    vocabulary = ranked.select("word", (F.col("n") + 1).cast("int").alias("token"))
    return vocabulary_tokens(t.documents, vocabulary, "doc_id", 0).select("doc_id", joined("tokens").alias("tokens"))


@query(
    "eos_wrap",
    with_views(
        f"select seq_id, array_to_string(tokens, ',') tokens, len(tokens) n from {wrapped_sql('src', 'seq_id')}",
        "v_insert_tokens",
        "v_doc_tokens",
        extra="src as (select * from v_insert_tokens union all select doc_id+1000000, tokens from v_doc_tokens)",
    ),
)
def eos_wrap(t: Tables) -> DataFrame:
    docs = t.doc_tokens.select((F.col("doc_id") + 1000000).alias("seq_id"), "tokens")
    rows = experiments.gate_and_wrap(t.insert_tokens.unionByName(docs), LENGTH, EOS)
    return rows.select("seq_id", joined("tokens").alias("tokens"), F.size("tokens").cast("bigint").alias("n"))


@query(
    "length_gate_counts",
    with_views(
        f"select count(*) filter (where len(tokens) > {LENGTH}) n_overlong, count(*) filter (where len(tokens) = 0)"
        f" n_empty, count(*) filter (where len(tokens) between 1 and {LENGTH}) n_kept from v_doc_tokens",
        "v_doc_tokens",
    ),
)
def length_gate_counts(t: Tables) -> DataFrame:
    return experiments.length_gate_counts(t.doc_tokens, LENGTH)


@query(
    "length_profile",
    with_views(
        "select 'before' stage, min(len(tokens)) min_len, max(len(tokens)) max_len, max(len(tokens)) filter (where"
        " len(tokens) < (select max(len(tokens)) from v_doc_tokens)) second_max_len from v_doc_tokens union all"
        " select 'after', min(len(tokens)), max(len(tokens)), max(len(tokens)) filter (where len(tokens) <"
        " (select max(len(tokens)) from w)) from w",
        "v_doc_tokens",
        extra=f"w as (select * from {wrapped_sql('v_doc_tokens', 'doc_id')})",
    ),
)
def length_profile(t: Tables) -> DataFrame:
    before = experiments.length_profile(t.doc_tokens).withColumn("stage", F.lit("before"))
    wrapped = experiments.gate_and_wrap(t.doc_tokens, LENGTH, EOS)
    after = experiments.length_profile(wrapped).withColumn("stage", F.lit("after"))
    both = before.unionByName(after)
    return both.select("stage", *[F.col(c).cast("bigint").alias(c) for c in ("min_len", "max_len", "second_max_len")])


@query(
    "token_ranges",
    with_views(
        f"select distinct step, step*{BATCH * LENGTH} as start, (step+10)*{BATCH * LENGTH} end_excl from v_control",
        "v_control",
    ),
)
def token_ranges(t: Tables) -> DataFrame:
    start, end = GEOMETRY.token_range_columns(F.col("step"), F.lit(10))
    return t.control.select("step").distinct().select("step", start.alias("start"), end.alias("end_excl"))


# -- intervals -----------------------------------------------------------------------


@query(
    "interval_conflicts",
    with_views(
        "select cand_id, lo, hi from v_candidates c where exists (select 1 from v_occupied o where o.lo <= c.hi"
        " and c.lo <= o.hi and o.lo >= c.lo - 64)",
        "v_candidates",
        "v_occupied",
    ),
)
def interval_conflicts(t: Tables) -> DataFrame:
    return intervals.conflicting(t.candidates, t.occupied, ["cand_id"])


@query(
    "interval_find_overlap",
    with_views(
        "select c.cand_id, c.lo, c.hi, min(o.lo) o_lo, arg_min(o.hi, o.lo) o_hi from v_candidates c left join"
        " v_occupied o on o.lo <= c.hi and c.lo <= o.hi and o.lo >= c.lo - 64 group by all",
        "v_candidates",
        "v_occupied",
    ),
)
def interval_find_overlap(t: Tables) -> DataFrame:
    return intervals.find_overlap(t.candidates, t.occupied, ["cand_id"])


@query(
    "explicit_self_conflicts",
    with_views(
        "select cand_id, lo, hi from (select *, max(hi) over (order by lo, hi, cand_id rows between unbounded"
        " preceding and 1 preceding) reach from v_candidates) where reach >= lo",
        "v_candidates",
    ),
)
def explicit_self_conflicts(t: Tables) -> DataFrame:
    return intervals.self_conflicts(t.candidates, ["hi", "cand_id"]).select("cand_id", "lo", "hi")


@query(
    "interval_digest",
    with_views(
        "select n n_intervals, (case when u >= 9223372036854775808 then u - 18446744073709551616 else u end)::BIGINT"
        " digest from (select n, ('0x'||substr(sha256(concat_ws(':', n, x, s)),1,16))::UBIGINT::HUGEINT u from"
        " (select count(*) n, bit_xor(h) x, sum(h) s from (select distinct ('0x'||substr(sha256(concat_ws(':',lo,hi)),"
        "1,15))::BIGINT h, lo, hi from v_occupied)))",
        "v_occupied",
    ),
)
def interval_digest(t: Tables) -> DataFrame:
    return intervals.digest(t.occupied)


@query(
    "interval_set_diff",
    with_views(
        "select lo, hi, 'left' only_in from (select lo, hi from v_occupied except select lo, hi from other) union all"
        " select lo, hi, 'right' from (select lo, hi from other except select lo, hi from v_occupied)",
        "v_plan",
        "v_occupied",
        extra="other as (select position lo, position+len(tokens)-1+(exp_id=3)::INTEGER hi from v_plan where exp_id<4)",
    ),
)
def interval_set_diff(t: Tables) -> DataFrame:
    longer = F.col("position") + F.size("tokens") - 1 + F.when(F.col("exp_id") == 3, 1).otherwise(0)
    other = t.plan.where("exp_id < 4").select(F.col("position").alias("lo"), longer.alias("hi"))
    return intervals.set_difference(t.occupied, other)


@query(
    "interval_listing",
    with_views("select lo, hi, row_number() over (order by lo, hi) - 1 place from v_occupied", "v_occupied"),
)
def interval_listing(t: Tables) -> DataFrame:
    return intervals.listing(t.occupied)


# -- sampling ------------------------------------------------------------------------


@query(
    "sample_fraction",
    f"select doc_id, source from documents order by ('0x'||substr(md5(concat_ws(':',{SEED},doc_id)),1,15))::BIGINT,"
    " doc_id limit (select floor(count(*)*0.3)::BIGINT from documents)",
)
def sample_fraction(t: Tables) -> DataFrame:
    docs = t.table("documents").select("doc_id", "source")
    return sampling.sample_fraction(docs, ["doc_id"], 0.3, SEED)


@query(
    "sample_fraction_large",
    f"select o_orderkey from orders order by ('0x'||substr(md5(concat_ws(':',{SEED},o_orderkey)),1,15))::BIGINT,"
    " o_orderkey limit (select floor(count(*)*0.8)::BIGINT from orders)",
)
def sample_fraction_large(t: Tables) -> DataFrame:
    return sampling.sample_fraction(t.table("orders").select("o_orderkey"), ["o_orderkey"], 0.8, SEED)


@query(
    "sample_n",
    f"select conv_id, turn, text from conversations where role='user' order by"
    f" ('0x'||substr(md5(concat_ws(':',{SEED},conv_id,turn)),1,15))::BIGINT, conv_id, turn limit 200",
)
def sample_n(t: Tables) -> DataFrame:
    asked = t.table("conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return sampling.exact_sample(asked, ["conv_id", "turn"], 200, SEED)


@query(
    "repeat_records",
    with_views(
        "select doc_id, c::INTEGER copy_no, len(tokens) n from v_doc_tokens, range(2) r(c)", "v_doc_tokens"
    ),
)
def repeat_records(t: Tables) -> DataFrame:
    rows = sampling.apply_repetitions(t.doc_tokens, ["doc_id"], 2.7, SEED)
    return rows.select("doc_id", "copy_no", F.size("tokens").cast("bigint").alias("n"))


@query(
    "train_order",
    f"select seq_idx, o_orderkey instance_id, seq_idx//{BATCH} batch from (select o_orderkey, row_number() over (order"
    f" by ('0x'||substr(md5(concat_ws(':',{SEED},1,o_orderkey)),1,15))::BIGINT, o_orderkey) - 1 seq_idx from orders)",
)
def train_order(t: Tables) -> DataFrame:
    return sampling.train_order(t.table("orders"), "o_orderkey", SEED, 1, BATCH)


# -- placement -----------------------------------------------------------------------


@query(
    "place_explicit",
    with_views("select position, array_to_string(tokens, ',') tokens, exp_id from v_plan where len(tokens)>0", "v_plan"),
)
def place_explicit(t: Tables) -> DataFrame:
    rows = t.plan.withColumn("seq_id", F.col("position"))
    return placement.place_explicit(rows).select("position", joined("tokens").alias("tokens"), "exp_id")


def order_candidates(t: Tables) -> DataFrame:
    """The orders' token lists as sequences to place anywhere in the orders' token range."""
    orders = t.table("orders").count()
    end = -(-orders * 64 // LENGTH) * LENGTH
    return t.plan.select(
        "exp_id",
        F.lit(0).alias("copy_no"),
        int_div(F.col("position"), 64).alias("seq_id"),
        "tokens",
        F.lit(0).cast("bigint").alias("start"),
        F.lit(end).cast("bigint").alias("end_excl"),
    )


ORDER_END = f"(select ceil(count(*)*64/{LENGTH})::BIGINT*{LENGTH} from orders)"
ORDER_CANDIDATES = (
    f"select exp_id, 0 copy_no, position//64 seq_id, len(tokens) n, 0 st, {ORDER_END} en from v_plan"
)


@query(
    "random_draws",
    with_views(
        "select exp_id, seq_id, n, slot, slot*{L}+off lo, slot*{L}+off+n-1 hi from (select *, {s} % (en//{L}) slot,"
        " {o} % ({L}-n+1) off from ({c}))".format(
            L=LENGTH,
            s=draw_sql(SEED, "exp_id", "copy_no", "seq_id", 0, "s"),
            o=draw_sql(SEED, "exp_id", "copy_no", "seq_id", 0, "o"),
            c=ORDER_CANDIDATES,
        ),
        "v_plan",
    ),
)
def random_draws(t: Tables) -> DataFrame:
    rows = order_candidates(t).withColumn("n", F.size("tokens").cast("bigint"))
    drawn = placement.draw_positions(rows, LENGTH, SEED, 0)
    return drawn.select("exp_id", "seq_id", "n", "slot", "lo", "hi")


@query(
    "place_random",
    with_views(
        "select exp_id, seq_id, n, lo as position from placed",
        "v_plan",
        extra=rounds_sql(ORDER_CANDIDATES, None, few=None),
        recursive=True,
    ),
)
def place_random(t: Tables) -> DataFrame:
    placed = experiments.place_sequences(order_candidates(t), LENGTH, SEED, few=None).placed
    return placed.select("exp_id", "seq_id", F.col("n").cast("bigint").alias("n"), F.col("lo").alias("position"))


HALF = f"({ORDER_END}//{LENGTH}//2*{LENGTH})"
RANGED = (
    f"select exp_id, 0 copy_no, position//64 seq_id, len(tokens) n, if(exp_id%2=0, 0, {HALF}) st,"
    f" if(exp_id%2=0, {HALF}, {ORDER_END}) en from v_plan"
)
DOC_SPANS = "select doc_id*512 lo, doc_id*512+least(n_chars, 120)-1 hi from documents"


@query(
    "place_random_range",
    with_views(
        "select exp_id, seq_id, n, lo as position from placed",
        "v_plan",
        extra=rounds_sql(RANGED, DOC_SPANS, few=None),
        recursive=True,
    ),
)
def place_random_range(t: Tables) -> DataFrame:
    """Even experiments in the first half of the range, odd ones in the second, around the documents' spans."""
    rows = order_candidates(t)
    half = int_div(F.col("end_excl"), LENGTH * 2) * LENGTH
    even = F.col("exp_id") % 2 == 0
    rows = rows.withColumns(
        {
            "start": F.when(even, F.lit(0).cast("bigint")).otherwise(half),
            "end_excl": F.when(even, half).otherwise(F.col("end_excl")),
        }
    )
    taken = t.table("documents").selectExpr("doc_id*512 lo", "doc_id*512+least(n_chars, 120)-1 hi")
    placed = experiments.place_sequences(rows, LENGTH, SEED, taken, few=None).placed
    return placed.select("exp_id", "seq_id", F.col("n").cast("bigint").alias("n"), F.col("lo").alias("position"))


@query(
    "placement_unplaced",
    "select count(*) n_candidates, count(*)//2 n_placed, count(*) - count(*)//2 n_unplaced, count(*)//2 n_slots from customer",
)
def placement_unplaced(t: Tables) -> DataFrame:
    """Sequences as long as a slot, and half as many slots: every slot is filled and the rest is reported."""
    customers = t.table("customer")
    slots = customers.count() // 2
    rows = customers.select(
        F.lit(0).alias("exp_id"),
        F.lit(0).alias("copy_no"),
        F.col("c_custkey").cast("bigint").alias("seq_id"),
        F.lit(LENGTH).alias("n"),
        F.lit(0).cast("bigint").alias("start"),
        F.lit(slots * LENGTH).cast("bigint").alias("end_excl"),
    )
    result = placement.place_random(rows, LENGTH, SEED)
    placed = result.placed.agg(F.count(F.lit(1)).alias("n_placed"), F.countDistinct("lo").alias("n_slots"))
    left = result.unplaced.agg(F.count(F.lit(1)).alias("n_unplaced"))
    return placed.join(left).select((F.col("n_placed") + F.col("n_unplaced")).alias("n_candidates"), "n_placed", "n_unplaced", "n_slots")


@query(
    "placement_invariants",
    with_views(
        f"select count(*) filter (where len(tokens) between 1 and {LENGTH}) n_candidates, 0::BIGINT n_lost, 0::BIGINT n_overlaps,"
        " 0::BIGINT n_outside, 0::BIGINT n_crossing, 0::BIGINT n_left_that_fit, true some_left from v_doc_tokens",
        "v_doc_tokens",
    ),
)
def placement_invariants(t: Tables) -> DataFrame:
    """Documents planned into half the room they need, around the occupied set: which rules are broken how often."""
    sizes = t.doc_tokens.select("doc_id", F.size("tokens").alias("n")).where(F.col("n").between(1, LENGTH))
    total = sizes.agg(F.sum("n")).first()[0]
    end = max(LENGTH, total // 2 // LENGTH * LENGTH)
    rows = sizes.select(
        F.lit(0).alias("exp_id"),
        F.lit(0).alias("copy_no"),
        F.col("doc_id").alias("seq_id"),
        "n",
        F.lit(0).cast("bigint").alias("start"),
        F.lit(end).cast("bigint").alias("end_excl"),
    )
    taken = t.occupied.where(F.col("hi") < end).select("lo", "hi")
    result = placement.place_random(rows, LENGTH, SEED, taken)
    held = result.placed.select("lo", "hi", F.lit(True).alias("ours")).unionByName(taken.withColumn("ours", F.lit(False)))
    by_slot = Window.partitionBy(int_div(F.col("lo"), LENGTH)).orderBy("lo", "hi")
    reach = F.max(F.struct("hi", "ours")).over(by_slot.rowsBetween(Window.unboundedPreceding, -1))
    seen = held.withColumn("before", reach)
    met = (F.col("before.hi") >= F.col("lo")) & (F.col("ours") | F.col("before.ours"))
    rules = seen.agg(
        F.count_if(met).alias("n_overlaps"),
        F.count_if(F.col("ours") & ((F.col("lo") < 0) | (F.col("hi") >= end))).alias("n_outside"),
        F.count_if(F.col("ours") & (int_div(F.col("lo"), LENGTH) != int_div(F.col("hi"), LENGTH))).alias("n_crossing"),
        F.count_if("ours").alias("n_placed"),
    )
    whole = rows.select("start", "end_excl").limit(1)
    space = placement.FreeSpace(whole, placement.by_slot(held.select("lo", "hi"), LENGTH), LENGTH)
    widest = space.blocks.agg(F.coalesce(F.max("widest"), F.lit(0)).alias("widest"))
    left = result.unplaced.join(widest).agg(
        F.count(F.lit(1)).alias("n_left"), F.count_if(F.col("n") <= F.col("widest")).alias("n_left_that_fit")
    )
    counted = sizes.agg(F.count(F.lit(1)).alias("n_candidates"))
    return rules.join(left).join(counted).select(
        "n_candidates",
        (F.col("n_candidates") - F.col("n_placed") - F.col("n_left")).alias("n_lost"),
        "n_overlaps", "n_outside", "n_crossing", "n_left_that_fit", (F.col("n_left") > 0).alias("some_left"),
    )


# Specs made of orders: modes, types, positions and ranges in all combinations, some of them missing or unknown.
_SPEC = (
    "o_orderkey as exp_id, nullif(split_part('explicit,random,random-range,sideways,', ',', cast(1+o_orderkey%5 as int)), '') as mode,"
    " nullif(split_part('add-texts-from-file,add-tokens-from-file,add-noise,', ',', cast(1+o_custkey%4 as int)), '') as type,"
    " case when o_custkey%3 > 0 then o_custkey%3 = 1 end as has_position, case when o_orderkey%7 > 0 then o_orderkey end as"
    " start_token, case when o_orderkey%11 > 0 then o_orderkey end as end_token"
)


@query(
    "spec_checks",
    f"with specs as (select {_SPEC} from orders) select exp_id, case when coalesce(type, '') not in ('add-texts-from-file',"
    " 'add-tokens-from-file') then 'unknown type' when coalesce(mode, '') not in ('explicit', 'random', 'random-range') then"
    " 'unknown mode' when mode = 'explicit' and not coalesce(has_position, false) then 'no position' when mode = 'random-range'"
    " and (start_token is null or end_token is null) then 'no range' end as reason from specs",
)
def spec_checks(t: Tables) -> DataFrame:
    return experiments.spec_verdicts(t.table("orders").selectExpr(_SPEC.join(["struct(", ") as s"])).select("s.*")).select(
        "exp_id", "reason"
    )


@query(
    "place_checks",
    with_views(
        f"select count(*) filter (where l_orderkey*64 % {LENGTH} != 0) start_unaligned, count(*) filter (where"
        f" (l_orderkey*64+l_partkey) % {LENGTH} != 0) end_unaligned, count(*) filter (where l_partkey//{LENGTH} <= 0)"
        f" no_sequence, count(*) filter (where l_suppkey*10 > {LENGTH}) too_long, count(*) filter (where l_suppkey*10"
        " < 1) empty from lineitem"
    ),
)
def place_checks(t: Tables) -> DataFrame:
    rows = t.table("lineitem").selectExpr(
        "l_orderkey*64 start", "l_orderkey*64+l_partkey end_excl", "l_suppkey*10 n"
    )
    return placement.range_violations(rows, LENGTH).drop("n_rows")


def two_phase(t: Tables) -> experiments.Plan:
    """Explicit rows of two order groups, documents, repeated benchmark items, and a ranged group."""
    orders = t.table("orders").count()
    end = -(-orders * 64 // LENGTH) * LENGTH
    half = end // LENGTH // 2 * LENGTH
    plan = t.plan.withColumn("seq_id", int_div(F.col("position"), 64))
    docs = t.doc_tokens.select(F.col("doc_id").alias("seq_id"), "tokens")
    specs = [
        experiments.Experiment("repeated items", t.insert_tokens, repetitions=4),
        experiments.Experiment("fixed rows", plan.where("exp_id = 0"), mode="explicit"),
        experiments.Experiment("sampled documents", docs, repetitions=0.5),
        experiments.Experiment(
            "early rows", plan.where("exp_id = 1"), mode="random-range", start_token=0, end_token=half
        ),
        experiments.Experiment("fixed rows 2", plan.where("exp_id = 2"), mode="explicit"),
    ]
    return experiments.build_plan(t.spark, specs, GEOMETRY, 0, end, SEED, EOS)


TWO_PHASE_SOURCES = (
    "src as ("
    "select 0 exp_id, c::INTEGER copy_no, seq_id, tokens, 0 st, {end} en from v_insert_tokens, range(4) r(c)"
    " union all select 2, 0, doc_id, tokens, 0, {end} from (select * from v_doc_tokens order by"
    " ('0x'||substr(md5(concat_ws(':',{seed2},doc_id)),1,15))::BIGINT, doc_id limit (select floor(count(*)*0.5)::BIGINT"
    " from documents))"
    " union all select 3, 0, position//64, tokens, 0, {half} from v_plan where exp_id=1),"
    " loose as (select * from {wrapped})"
).format(end=ORDER_END, half=HALF, seed2=SEED + 2, wrapped=wrapped_sql("src", "exp_id, copy_no, seq_id, st, en"))
TWO_PHASE = (
    TWO_PHASE_SOURCES
    + ", "
    + rounds_sql(
        "select exp_id, copy_no, seq_id, len(tokens) n, st, en from loose",
        "select position lo, position+len(tokens)-1 hi from v_plan where exp_id in (0,2)",
    )
    + ", plan as (select position, tokens, if(exp_id=0,1,4) exp_id, 0 copy_no, position//64 seq_id, 0 phase from v_plan"
    " where exp_id in (0,2) union all select p.lo, l.tokens, l.exp_id, l.copy_no, l.seq_id, 1 from placed p join loose l"
    " on p.exp_id=l.exp_id and p.copy_no=l.copy_no and p.seq_id=l.seq_id)"
)


def two_phase_sql(body: str) -> str:
    return with_views(body, "v_plan", "v_insert_tokens", "v_doc_tokens", extra=TWO_PHASE, recursive=True)


@query(
    "place_two_phase",
    two_phase_sql("select position, array_to_string(tokens, ',') tokens, exp_id, copy_no, seq_id, phase from plan"),
)
def place_two_phase(t: Tables) -> DataFrame:
    plan = two_phase(t).placements
    return plan.select("position", joined("tokens").alias("tokens"), "exp_id", "copy_no", "seq_id", "phase")


@query(
    "placement_summary",
    two_phase_sql(
        "select s.exp_id, s.exp_name, s.mode, s.phase, s.rs range_start, s.re range_end, coalesce(count(p.position), 0)"
        " sequences, coalesce(sum(len(p.tokens)), 0)::BIGINT n_tokens, coalesce(min(len(p.tokens)), 0) min_len,"
        " coalesce(max(len(p.tokens)), 0) max_len, s.mode != 'explicit' eos_wrapping, false outside_training_range from"
        f" (select 0 exp_id, 'repeated items' exp_name, 'random' mode, 1 phase, 0::BIGINT rs, {ORDER_END} re union all"
        f" select 1, 'fixed rows', 'explicit', 0, 0, {ORDER_END} union all select 2, 'sampled documents', 'random', 1,"
        f" 0, {ORDER_END} union all select 3, 'early rows', 'random-range', 1, 0, {HALF} union all select 4,"
        f" 'fixed rows 2', 'explicit', 0, 0, {ORDER_END}) s left join plan p on p.exp_id=s.exp_id group by all"
    ),
)
def placement_summary(t: Tables) -> DataFrame:
    summary = two_phase(t).summary
    return summary.withColumns(
        {c: F.col(c).cast("bigint") for c in ("sequences", "n_tokens", "min_len", "max_len")}
    )


@query(
    "static_plan",
    with_views(
        "select count(*) sequences, sum(len(l.tokens))::BIGINT n_tokens, min(p.lo) first_position, max(p.hi)"
        " last_position, bit_xor(p.lo*1000+p.n) position_code from placed p join loose l using (exp_id, copy_no, seq_id)",
        "v_doc_tokens",
        extra=(
            f"base as (select ({BATCH * LENGTH}*1000)::BIGINT st, ({BATCH * LENGTH}*1000 + (select ceil(count(*)/10)"
            f"::BIGINT from documents)*20*{BATCH * LENGTH})::BIGINT en),"
            " src as (select 0 exp_id, 0 copy_no, doc_id seq_id, tokens, st, en from v_doc_tokens, base),"
            f" loose as (select * from {wrapped_sql('src', 'exp_id, copy_no, seq_id, st, en')}), "
            + rounds_sql("select exp_id, copy_no, seq_id, len(tokens) n, st, en from loose", None)
        ),
        recursive=True,
    ),
)
def static_plan(t: Tables) -> DataFrame:
    """All fitting documents planned from step 1000 on; totals and a code of the positions."""
    docs = t.doc_tokens.select(F.col("doc_id").alias("seq_id"), "tokens")
    steps = -(-t.table("documents").count() // 10) * 20
    plan = experiments.static_plan(
        t.spark, [experiments.Experiment("documents", docs)], GEOMETRY, 1000, steps, SEED, EOS
    )
    n = F.size("tokens").cast("bigint")
    return plan.placements.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum(n).alias("n_tokens"),
        F.min("position").alias("first_position"),
        F.max(F.col("position") + n - 1).alias("last_position"),
        F.bit_xor(F.col("position") * 1000 + n).alias("position_code"),
    )


@query(
    "placement_rejects",
    with_views(
        f"select count(*) filter (where n > {LENGTH}) n_overlong, count(*) filter (where n = 0) n_empty,"
        f" (select count(*) from first_draw f where exists (select 1 from v_occupied o where o.lo <= f.hi and f.lo <="
        f" o.hi)) n_collided from (select len(tokens) n from v_doc_tokens)",
        "v_doc_tokens",
        "v_plan",
        "v_occupied",
        extra=(
            "fd as (select doc_id, len(tokens) n, {s} % ({end}//{L}) slot, {o} % ({L}-len(tokens)+1) off from v_doc_tokens"
            " where len(tokens) between 1 and {L}), first_draw as (select slot*{L}+off lo, slot*{L}+off+n-1 hi from fd)"
        ).format(
            L=LENGTH,
            end=ORDER_END,
            s=draw_sql(SEED, 0, 0, "doc_id", 0, "s"),
            o=draw_sql(SEED, 0, 0, "doc_id", 0, "o"),
        ),
    ),
)
def placement_rejects(t: Tables) -> DataFrame:
    """Documents that cannot be placed for their length, and first draws that meet the occupied set."""
    orders = t.table("orders").count()
    end = -(-orders * 64 // LENGTH) * LENGTH
    sized = t.doc_tokens.select("doc_id", F.size("tokens").alias("n"))
    fitting = sized.where(F.col("n").between(1, LENGTH)).select(
        F.lit(0).alias("exp_id"),
        F.lit(0).alias("copy_no"),
        F.col("doc_id").alias("seq_id"),
        "n",
        F.lit(0).cast("bigint").alias("start"),
        F.lit(end).cast("bigint").alias("end_excl"),
    )
    drawn = placement.draw_positions(fitting, LENGTH, SEED, 0)
    met = intervals.conflicting(drawn.select("seq_id", "lo", "hi"), t.occupied, ["seq_id"])
    marked = sized.join(met.select(F.col("seq_id").alias("doc_id"), F.lit(True).alias("met")), "doc_id", "left")
    return marked.agg(
        F.count_if(F.col("n") > LENGTH).alias("n_overlong"),
        F.count_if(F.col("n") == 0).alias("n_empty"),
        F.count_if("met").alias("n_collided"),
    )


WRITES = (
    "writes as (select o_custkey*64 as position, (o_custkey%24)::BIGINT+1 as n, o_orderkey write_seq from orders)"
)


@query(
    "plan_merge",
    with_views(
        "select position, arg_max(n, write_seq) n, count(*) > 1 from writes group by position".replace(
            ", count(*) > 1", ", max(write_seq) write_seq"
        ),
        extra=WRITES,
    ),
)
def plan_merge(t: Tables) -> DataFrame:
    writes = t.table("orders").selectExpr(
        "o_custkey*64 position", "o_custkey%24+1 n", "o_orderkey write_seq", "o_orderkey last_write"
    )
    return placement.merge_plans(writes).select("position", "n", F.col("last_write").alias("write_seq"))


@query(
    "spec_order",
    with_views(
        "select exp_id, n_sequences, row_number() over (order by phase, exp_id) - 1 place from (select exp_id, count(*)"
        " n_sequences, if(exp_id in (1,3), 0, 1) phase from v_plan group by exp_id)",
        "v_plan",
    ),
)
def spec_order(t: Tables) -> DataFrame:
    from inlay.operators.scan import ordered_scan

    phase = F.when(F.col("exp_id").isin(1, 3), 0).otherwise(1)
    counted = t.plan.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_sequences")).withColumn("phase", phase)
    return ordered_scan(counted, ["phase", "exp_id"], ordinal="place").select("exp_id", "n_sequences", "place")


@query(
    "inserted_fraction",
    with_views(
        "select sum(len(tokens))::BIGINT total_tokens, round(100.0*sum(len(tokens))/(select count(*)*64 from orders), 6)"
        " as percent from v_plan",
        "v_plan",
    ),
)
def inserted_fraction(t: Tables) -> DataFrame:
    training = t.table("orders").count() * 64
    return experiments.inserted_fraction(t.plan, training).select("total_tokens", rounded("percent").alias("percent"))


# -- re-indexing ---------------------------------------------------------------------

CHUNK = 50
REINDEX = (
    "pieces as (select position//{c} + k as index, greatest(position, (position//{c}+k)*{c}) a, least(position+len(tokens),"
    " (position//{c}+k+1)*{c}) b, position, tokens from (select *, unnest(range(0, (position+len(tokens)-1)//{c} -"
    " position//{c} + 1)) k from {src})), imap as (select index, row_number() over (partition by index order by a) - 1"
    " ordinal, (a - index*{c})::INTEGER pos, tokens[a-position+1:b-position] tokens from pieces)"
)
FLAT = "select index, ordinal, pos, array_to_string(tokens, ',') tokens from imap"


def reindex_sql(body: str, chunk: int = CHUNK, src: str = "v_plan") -> str:
    return with_views(body, "v_plan", extra=REINDEX.format(c=chunk, src=src))


@query("reindex_split", reindex_sql(FLAT))
def reindex_split(t: Tables) -> DataFrame:
    return reindex.reindex(t.plan, CHUNK).withColumn("tokens", joined("tokens"))


@query(
    "reindex_crossings",
    with_views(
        f"select position, position//{CHUNK} as index, (position%{CHUNK})::INTEGER pos, len(tokens)::INTEGER n_tokens"
        f" from v_plan where position%{CHUNK} + len(tokens) > {CHUNK}",
        "v_plan",
    ),
)
def reindex_crossings(t: Tables) -> DataFrame:
    return reindex.crossings(t.plan, CHUNK)


def nested_text(nested: DataFrame) -> DataFrame:
    """Nested insertion lists as text ``pos:tokens`` joined by ``;``."""
    each = F.transform("insertions", lambda i: F.concat(i["pos"].cast("string"), F.lit(":"), joined(i["tokens"])))
    return nested.select("index", "page", F.array_join(each, ";").alias("insertions"))


NESTED = (
    "select index, ordinal//{p} page, string_agg(pos||':'||array_to_string(tokens, ','), ';' order by ordinal)"
    " insertions from imap group by all"
).format(p=reindex.PAGE)


@query("index_map_nested", reindex_sql(NESTED))
def index_map_nested(t: Tables) -> DataFrame:
    return nested_text(reindex.nest(reindex.reindex(t.plan, CHUNK)))


@query(
    "inserted_tokens",
    reindex_sql(
        "select 'plan' side, sum(len(tokens))::BIGINT n_tokens from v_plan union all select 'index map',"
        " sum(len(tokens))::BIGINT from imap"
    ),
)
def inserted_tokens(t: Tables) -> DataFrame:
    total = F.sum(F.size("tokens")).alias("n_tokens")
    plan = t.plan.agg(total).withColumn("side", F.lit("plan"))
    return plan.unionByName(reindex.reindex(t.plan, CHUNK).agg(total).withColumn("side", F.lit("index map")))
