"""Queries run as Structured Streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.functions.tokenizers import word_tokens
from inlay.operators import index_map
from inlay.plans.catalog import joined, query, rounded
from inlay.plans.placement_queries import CHUNK, FLAT, GEOMETRY, reindex_sql, rounds_sql, wrapped_sql
from inlay.plans.views import BATCH, EOS, LENGTH, SEED, Tables, with_views
from inlay.session import DEFAULTS
from inlay.sources.records import control_prompts
from inlay.staging import materialize, new_path
from inlay.streaming import append, control

EVERY = 10
STEP_TOKENS = BATCH * LENGTH


def stream_of(t: Tables, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = t.table(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def control_events(t: Tables) -> DataFrame:
    return stream_of(t, "events").selectExpr(
        "event_type experiment", "event_id div 100 step", "cast(round(value*100) as bigint) amount"
    )


@query("stream_append", reindex_sql(FLAT))
def stream_append(t: Tables) -> DataFrame:
    plan = stream_of(t, "orders").selectExpr(
        "o_orderkey*64 + o_custkey%32 position",
        "transform(sequence(1, cast(1+o_custkey%24 as int)), i -> cast(o_orderkey%1000 as int)*32+i) tokens",
    )
    store = index_map.IndexMap(t.spark, new_path(t.spark, "streamed"))
    append.append_stream(plan, store, CHUNK, new_path(t.spark, "progress")).awaitTermination()
    return store.rows().withColumn("tokens", joined("tokens"))


@query(
    "control_prompts",
    with_views("select prompt_id, nullif(\"text\", 'evt 1 view') as \"text\" from v_control where \"text\" != 'evt 1 view'", "v_control"),
)
def control_prompts_query(t: Tables) -> DataFrame:
    texts = t.control.select("prompt_id", F.nullif("text", F.lit("evt 1 view")).alias("text"))
    return control_prompts(texts)


@query(
    "control_periods",
    with_views(
        "select p period_step, least(8, (select max(step)-2 from v_control) - p) n_steps from (select distinct step//8*8 p"
        " from v_control where step < (select max(step)-2 from v_control))",
        "v_control",
    ),
)
def control_periods(t: Tables) -> DataFrame:
    steps = t.control.select("step").distinct()
    end = steps.agg(F.max("step")).first()[0] - 2
    return control.periods(steps, 0, end, 8)


STATES = (
    "seen as (select event_type experiment, event_id//100//10*10 step, count(*) n, sum(round(value*100)::BIGINT) amount from"
    " events group by all), every as (select experiment, unnest(range(0, max(step)+1, 10)) step from seen group by experiment),"
    " p as (select experiment, step, coalesce(n, 0) n, coalesce(amount, 0) amount from every left join seen using (experiment,"
    " step)), s as (select experiment, step, sum(n) over w n, sum(amount) over w level, amount latest from p"
    " window w as (partition by experiment order by step))"
)


def running_totals(state: dict, step: int, total: int, seen: dict) -> dict:
    """A control program: counts and sums what was observed so far."""
    return {
        "n": state["n"] + seen["n"],
        "level": state["level"] + seen["amount"],
        "latest": float(seen["amount"]),
    }


def run_to_end(t: Tables, out: DataFrame) -> DataFrame:
    """All rows that a control stream gave out."""
    path = new_path(t.spark, "states")
    query = (
        out.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_path(t.spark, "progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return t.spark.read.schema(control.STATE_SCHEMA).parquet(path)


def end_of_run(t: Tables) -> int:
    # the driver may start its session without the package's defaults
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", DEFAULTS["spark.sql.streaming.stateStore.providerClass"])
    return t.table("events").agg(F.max(F.expr("event_id div 100"))).first()[0] + 1


def states(t: Tables) -> DataFrame:
    """The control stream run to its end, its output read back."""
    end = end_of_run(t)
    out = control.control_state(control_events(t), running_totals, {"n": 0.0, "level": 0.0}, 0, end, EVERY)
    return control.latest_states(run_to_end(t, out))


@query(
    "control_state",
    with_views(
        "select experiment, step, n::DOUBLE n, level::DOUBLE as level, latest::DOUBLE latest from s", extra=STATES
    ),
)
def control_state(t: Tables) -> DataFrame:
    keys = ("n", "level", "latest")
    return states(t).select("experiment", "step", *[F.col("state")[k].alias(k) for k in keys])


@query(
    "control_metrics",
    with_views(
        "select step, 'control/'||experiment||'_n' metric, n::DOUBLE as value from s union all select step,"
        " 'control/'||experiment||'_level', level::DOUBLE from s union all select step,"
        " 'control/'||experiment||'_latest', latest::DOUBLE from s",
        extra=STATES,
    ),
)
def control_metrics(t: Tables) -> DataFrame:
    return control.control_metrics(states(t)).withColumn("value", rounded("value"))


def trending(state: dict, step: int, total: int, seen: dict, unit: int = 1) -> dict:
    """A control program whose state holds a text, and which has an argument."""
    return {
        "n": state["n"] + seen["n"],
        "level": state["level"] + unit * seen["amount"],
        "latest": seen["amount"],
        "trend": "up" if seen["amount"] > state["latest"] else "down",
    }


TREND_START = {"n": 0, "level": 0, "latest": 0, "trend": "none"}


@query(
    "control_handover",
    with_views(
        "select experiment, step, n::DOUBLE n, level::DOUBLE as level, case when latest > coalesce(lag(latest) over"
        " (partition by experiment order by step), 0) then 'up' else 'down' end trend from s",
        extra=STATES,
    ),
)
def control_handover(t: Tables) -> DataFrame:
    """A control stream that ends half way and a second one that goes on from its state table."""
    end = end_of_run(t)
    half = end // 2 // EVERY * EVERY
    events = control_events(t)
    early = control.control_state(events.where(F.col("step") < half), trending, TREND_START, 0, end, EVERY)
    first = run_to_end(t, early)
    handed = materialize(control.last_states(first), "handed")
    late = control.control_state(
        events.where(F.col("step") >= half), trending, TREND_START, 0, end, EVERY, handed=handed, keep=3
    )
    both = control.latest_states(first).unionByName(control.latest_states(run_to_end(t, late)))
    entries = control.typed_state(both)
    return entries.select(
        "experiment",
        "step",
        F.col("state")["n"].alias("n"),
        F.col("state")["level"].alias("level"),
        F.variant_get(F.col("entries")["trend"], "$", "string").alias("trend"),
    )


@query(
    "control_programs",
    with_views(
        "select experiment, count(*) filter (experiment != 'error') n_run, count(*) filter (experiment = 'error') n_skipped,"
        " case when experiment != 'error' then arg_max(level, step) * if(experiment = 'click', 2, 1) end::DOUBLE last_level"
        " from s group by experiment",
        extra=STATES,
    ),
)
def control_programs(t: Tables) -> DataFrame:
    """A program with arguments for each experiment; the one without a state is skipped and counted."""
    end = end_of_run(t)
    kinds = [r[0] for r in t.table("events").select("event_type").distinct().collect()]
    controls = {
        kind: control.Control(trending, None if kind == "error" else TREND_START, {"unit": 2 if kind == "click" else 1})
        for kind in kinds
    }
    rows = run_to_end(t, control.control_state(control_events(t), controls, None, 0, end, EVERY))
    last = control.latest_states(rows).groupBy("experiment").agg(
        F.max_by(F.col("state")["level"], F.when(F.col("whole").isNotNull(), F.col("step"))).alias("last_level")
    )
    return control.skipped_periods(rows).join(last, "experiment")


_WORDS = "list_filter(regexp_split_to_array(\"text\",'[ \\n\\t\\r]+'), lambda x: x != '')"
_TOKENS = f"list_transform({_WORDS}, lambda x: (('0x'||substr(md5(x),1,7))::BIGINT+1)::INTEGER)"


@query(
    "control_period_plan",
    with_views(
        "select l.exp_id::BIGINT as period, l.seq_id, p.lo as position, array_to_string(l.tokens, ',') tokens from placed p"
        " join loose l using (exp_id, copy_no, seq_id)",
        "v_control",
        extra=(
            f"src as (select (step//{EVERY})::INTEGER exp_id, 0 copy_no, prompt_id seq_id, {_TOKENS} tokens,"
            f" step//{EVERY}*{EVERY * STEP_TOKENS} st, (step//{EVERY}+1)*{EVERY * STEP_TOKENS} en from v_control),"
            f" loose as (select * from {wrapped_sql('src', 'exp_id, copy_no, seq_id, st, en')}), "
            + rounds_sql("select exp_id, copy_no, seq_id, len(tokens) n, st, en from loose", None)
        ),
        recursive=True,
    ),
)
def control_period_plan(t: Tables) -> DataFrame:
    """Texts of the event stream placed at random inside their control period."""
    texts = stream_of(t, "events").selectExpr(
        "event_id div 100 step", "event_id prompt_id", "concat('evt ',user_id,' ',event_type) text"
    )
    path = new_path(t.spark, "periods")
    control.period_plan_stream(
        texts, word_tokens(F.col("text")), path, GEOMETRY, EVERY, SEED, EOS, new_path(t.spark, "progress")
    ).awaitTermination()
    rows = control.read_periods(t.spark, path)
    return rows.select("period", "seq_id", "position", joined("tokens").alias("tokens"))
