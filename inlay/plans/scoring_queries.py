"""Queries over scored and generated responses, metrics, and model plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inlay.evaluation import (
    arithmetic,
    choices,
    extraction,
    knowledge,
    memorization,
    metrics,
    perplexity,
    registry,
)
from inlay.functions.answers import ANSWER_LEAD, ANSWER_MARKERS, cut_after_answer, parse_answer
from inlay.functions.perturb import NOISE_STD, perturb
from inlay.functions.providers import BigramModel, EchoModel, generate, score
from inlay.functions.similarity import partial_similarity
from inlay.plans.catalog import joined, query, rounded
from inlay.plans.views import SEED, Tables, with_views
from inlay.sources import records

# -- responses -----------------------------------------------------------------------------


@query(
    "src_responses",
    with_views(
        "select query_id, array_to_string(token_ids, ',') token_ids, len(logprobs)::BIGINT n, round(list_sum(logprobs), 6)"
        " total from v_prompts_scored",
        "v_prompts_scored",
    ),
)
def src_responses(t: Tables) -> DataFrame:
    rows = t.prompts_scored
    total = F.aggregate(F.slice("logprobs", F.lit(2), F.size("logprobs")), F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "query_id",
        joined("token_ids").alias("token_ids"),
        F.size("logprobs").cast("bigint").alias("n"),
        rounded(total).alias("total"),
    )


@query(
    "plugin_logprobs",
    with_views(
        "select query_id, len(token_ids)::BIGINT n, round(coalesce(list_sum(list_transform(token_ids[2:], lambda x: -ln(2 + x % 5))),"
        " 0.0), 6) total from v_prompts_scored",
        "v_prompts_scored",
    ),
)
def plugin_logprobs(t: Tables) -> DataFrame:
    """Prompts through the scorer plug-in."""
    rows = score(t.prompts_scored.select("query_id", "token_ids"), EchoModel)
    total = F.aggregate("logprobs", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rows.select("query_id", F.size("logprobs").cast("bigint").alias("n"), rounded(total).alias("total"))


@query(
    "plugin_generate",
    with_views(
        "select query_id, array_to_string(if(len(token_ids) > 0, [token_ids[-1], token_ids[-1], token_ids[-1]], []), ',')"
        " generated from v_prompts_scored",
        "v_prompts_scored",
    ),
)
def plugin_generate(t: Tables) -> DataFrame:
    """Prompts through the generator plug-in."""
    rows = generate(t.prompts_scored.select("query_id", "token_ids"), EchoModel, 3)
    return rows.select("query_id", joined("generated").alias("generated"))


@query(
    "pair_responses",
    with_views(
        "select query_id, ops, answer, response from v_math",
        "v_math",
    ),
)
def pair_responses(t: Tables) -> DataFrame:
    """Questions and responses kept as two tables and joined by id."""
    rows = t.math
    return records.pair_responses(rows.select("query_id", "ops", "answer"), rows.select("query_id", "response"))


# -- ranked choice -----------------------------------------------------------------------------

RC = (
    "lo as (select doc_id, min(token_ids) a, max(token_ids) b from v_choices group by doc_id),"
    " p as (select c.doc_id, min(list_sum(list_transform(range(1, least(len(f.token_ids), len(c.token_ids))+1),"
    " lambda i: (f.token_ids[1:i] = c.token_ids[1:i])::INTEGER)))::BIGINT lcp from v_choices c join v_choices f on"
    " f.doc_id=c.doc_id and f.idx=0 group by c.doc_id),"
    " s as (select c.*, p.lcp, case when len(list_filter(logprobs[lcp+1:], lambda x: x is null)) > 0 then null else"
    " coalesce(list_sum(logprobs[lcp+1:]), 0) end raw from v_choices c join p using (doc_id)),"
    " n as (select *, case when norm='none' then raw when norm='char' and length(continuation) > 0 then"
    " raw/length(continuation) end mixed, raw/nullif(length(continuation), 0) per_char from s)"
)


def rc_picks(score: str) -> str:
    return (
        RC + f", best as (select doc_id, first(idx order by {score} desc, idx) picked, coalesce(min(idx) filter (where"
        f" label=idx), min(idx)) labelled, bool_or({score} is null) failed from n group by doc_id)"
    )


@query("rc_common_prefix", with_views("select doc_id, lcp from p", "v_choices", extra=RC))
def rc_common_prefix(t: Tables) -> DataFrame:
    return choices.common_prefix(t.choices)


@query("rc_scores", with_views("select doc_id, idx, lcp, round(raw, 6) score from n", "v_choices", extra=RC))
def rc_scores(t: Tables) -> DataFrame:
    return choices.choice_scores(t.choices).select("doc_id", "idx", "lcp", rounded("score").alias("score"))


@query(
    "rc_scores_char",
    with_views("select doc_id, idx, lcp, round(per_char, 9) score from n", "v_choices", extra=RC),
)
def rc_scores_char(t: Tables) -> DataFrame:
    return choices.choice_scores(t.choices, "char").select("doc_id", "idx", "lcp", rounded("score", 9).alias("score"))


@query(
    "rc_predictions",
    with_views(
        "select doc_id, picked, labelled, failed, not failed and picked=labelled correct from best",
        "v_choices",
        extra=rc_picks("mixed"),
    ),
)
def rc_predictions(t: Tables) -> DataFrame:
    return choices.predictions(choices.choice_scores(t.choices, "mixed"))


@query(
    "rc_accuracy",
    with_views(
        "select round(count(*) filter (where not failed and picked=labelled)/(max(doc_id)+1), 6) acc, count(*) n_present,"
        " count(*) filter (where failed) n_failed from best",
        "v_choices",
        extra=rc_picks("raw"),
    ),
)
def rc_accuracy(t: Tables) -> DataFrame:
    return choices.accuracy(t.choices).withColumn("acc", rounded("acc"))


# -- perplexity -----------------------------------------------------------------------------


@query(
    "ppl_truncate",
    with_views(
        "select doc_id, array_to_string(tokens[1:4095], ',') token_ids from v_doc_tokens", "v_doc_tokens"
    ),
)
def ppl_truncate(t: Tables) -> DataFrame:
    cut = perplexity.truncate(t.doc_tokens.withColumnRenamed("tokens", "token_ids"))
    return cut.select("doc_id", joined("token_ids").alias("token_ids"))


DISTINCT = (
    "d as (select min(query_id) query_id, array_to_string(token_ids, ',') token_ids, arg_min(logprobs, query_id) logprobs"
    " from v_prompts_scored group by token_ids)"
)


@query("ppl_distinct", with_views("select query_id, token_ids from d", "v_prompts_scored", extra=DISTINCT))
def ppl_distinct(t: Tables) -> DataFrame:
    rows = perplexity.scoring_input(t.prompts_scored)
    return rows.select("query_id", joined("token_ids").alias("token_ids"))


PPL = "(-sum(list_sum(logprobs[2:]))/sum(len(logprobs)-1))"


@query(
    "perplexity",
    with_views(
        f"select round({PPL}, 6) cross_entropy_loss, round(exp({PPL}), 6) perplexity from d",
        "v_prompts_scored",
        extra=DISTINCT,
    ),
)
def perplexity_query(t: Tables) -> DataFrame:
    result = perplexity.perplexity(perplexity.scoring_input(t.prompts_scored))
    return result.select(*[rounded(c).alias(c) for c in result.columns])


# -- knowledge -----------------------------------------------------------------------------

TARGET_SUM = "coalesce(list_sum(logprobs[input_tokens+1:]), 0)"
HIT = "contains(upper(generation), upper(trim(target)))"


@query(
    "query_text",
    with_views("select query_id, input || ' ' || target as query, input || ' now ' triggered from v_knowledge", "v_knowledge"),
)
def query_text(t: Tables) -> DataFrame:
    rows = knowledge.query_text(t.knowledge)
    return rows.select("query_id", "query", extraction.trigger_query(F.col("input"), "now").alias("triggered"))


@query(
    "detail_knowledge",
    with_views(
        f"select query_id, input, target, generation, round(exp({TARGET_SUM}), 6) probability, {HIT} hit from v_knowledge",
        "v_knowledge",
    ),
)
def detail_knowledge(t: Tables) -> DataFrame:
    rows = knowledge.details(t.knowledge, similarity=False)
    return rows.select("query_id", "input", "target", "generation", rounded("probability").alias("probability"), "hit")


@query(
    "knowledge_probe",
    with_views(
        f"select round(avg(exp({TARGET_SUM})), 6) probability, round(100*avg({HIT}::INTEGER), 6) accuracy from v_knowledge",
        "v_knowledge",
    ),
)
def knowledge_probe(t: Tables) -> DataFrame:
    result = knowledge.summary(t.knowledge, similarity=False)
    return result.select(*[rounded(c).alias(c) for c in result.columns])


# Longest common subsequences by one bit per character of the shorter text, over all windows of the longer one.
_ONES = "((1::HUGEINT << len(s)) - 1)"
_WINDOW = "masks[greatest(e - len(s), 0) + 1 : least(e, len(masks))]"
_LCS = (
    f"len(s) - bit_count(list_reduce(list_prepend({_ONES}, w), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {_ONES}))"
)
SIMILARITY = (
    "sides as (select query_id, target a, generation b from v_knowledge),"
    " pairs as (select query_id, string_split(if(length(a) <= length(b), a, b), '') s, string_split(if(length(a) <="
    " length(b), b, a), '') l from sides where length(a) > 0 and length(b) > 0 union all select query_id,"
    " string_split(b, ''), string_split(a, '') from sides where length(a) = length(b) and length(a) > 0),"
    " masked as (select query_id, if(len(s) > 126, error('text too long'), s) s, list_transform(l, lambda c: list_reduce("
    "list_prepend(0::HUGEINT, list_transform(range(len(s)), lambda i: if(s[i+1] = c, 1::HUGEINT << i::INTEGER, 0::HUGEINT))),"
    " lambda x, y: x | y)) masks from pairs),"
    f" windows as (select query_id, s, list_transform(range(1, len(s) + len(masks)), lambda e: {_WINDOW}) ws from masked),"
    f" best as (select query_id, max(list_max(list_transform(ws, lambda w: 200.0::DOUBLE * ({_LCS}) / (len(s) + len(w)))))"
    " best from windows group by 1),"
    " alike as (select query_id, case when a is null or b is null then 0 when a = '' or b = '' then if(a = b, 100, 0)"
    " else round_even(best, 0)::INTEGER end similarity from sides left join best using (query_id))"
)


@query(
    "knowledge_probe_full",
    with_views(
        f"select round(avg(exp({TARGET_SUM})), 6) probability, round(100*avg({HIT}::INTEGER), 6) accuracy,"
        " round(avg(similarity), 6) levenshtein from v_knowledge join alike using (query_id)",
        "v_knowledge",
        extra=SIMILARITY,
    ),
)
def knowledge_probe_full(t: Tables) -> DataFrame:
    """All three measures."""
    result = knowledge.summary(t.knowledge)
    return result.select(*[rounded(c).alias(c) for c in result.columns])


@query("partial_similarity", with_views("select query_id, similarity from alike", "v_knowledge", extra=SIMILARITY))
def partial_similarity_query(t: Tables) -> DataFrame:
    return t.knowledge.select("query_id", partial_similarity("target", "generation").alias("similarity"))


# -- arithmetic -----------------------------------------------------------------------------

_MARKERS = "[" + ", ".join("'" + m.replace("\n", "'||chr(10)||'") + "'" for m in ANSWER_MARKERS) + "]"
MATH = (
    "cut as (select query_id, ops, answer, substr(response, 1, coalesce(list_min(list_filter(list_transform("
    f"{_MARKERS}, lambda m: case when strpos(response, m) > 0 then strpos(response, m)+length(m)-1 end), lambda x: x is"
    " not null)), length(response))) response from v_math),"
    " word as (select *, regexp_extract(split_part(response, '{lead}', 2), '^\\s*(\\S+)', 1) w from cut),"
    " parsed as (select *, case when contains(response, '{lead}') and regexp_full_match(w, '[+-]?[0-9]+(_[0-9]+)*') then"
    " try_cast(replace(w, '_', '') as BIGINT) end parsed from word)"
).replace("{lead}", ANSWER_LEAD)


def math_sql(body: str) -> str:
    return with_views(body, "v_math", extra=MATH)


@query("math_cut", math_sql("select query_id, response from cut"))
def math_cut(t: Tables) -> DataFrame:
    return t.math.select("query_id", cut_after_answer(F.col("response")).alias("response"))


@query("math_parse", math_sql("select query_id, parsed from parsed"))
def math_parse(t: Tables) -> DataFrame:
    return t.math.select("query_id", parse_answer(cut_after_answer(F.col("response"))).alias("parsed"))


@query("math_questions", with_views("select query_id, answer::BIGINT answer from v_math where ops=2", "v_math"))
def math_questions(t: Tables) -> DataFrame:
    return arithmetic.questions(t.math, 2).select("query_id", "answer")


@query("math_accuracy", math_sql("select ops, round(avg(coalesce(parsed=answer, false)::INTEGER), 6) acc from parsed group by ops"))
def math_accuracy(t: Tables) -> DataFrame:
    return arithmetic.accuracy(t.math, by="ops").withColumn("acc", rounded("acc"))


@query(
    "detail_math",
    math_sql("select query_id, ops, answer, response, parsed, coalesce(parsed=answer, false) correct from parsed"),
)
def detail_math(t: Tables) -> DataFrame:
    return arithmetic.details(t.math)


# -- extraction -----------------------------------------------------------------------------

# word-level longest common subsequence: fold the reply's match rows into one row of the table
ROUGE = (
    "w as (select prompt_id, gen, prompt, generation, list_filter(string_split(regexp_replace(lower(prompt), '[^a-z0-9]+',"
    " ' ', 'g'), ' '), lambda x: x != '') a, list_filter(string_split(regexp_replace(lower(generation), '[^a-z0-9]+', ' ',"
    " 'g'), ' '), lambda x: x != '') b from v_generations),"
    " m as (select *, list_transform(b, lambda y: list_transform(a, lambda x: (x = y)::INTEGER)) hits from w),"
    " r as (select *, case when len(a) = 0 or len(b) = 0 then 0.0 else list_max(list_reduce(list_prepend(list_transform(a,"
    " lambda x: 0), hits), lambda acc, h: list_transform(range(1, len(acc)+1), lambda j: list_max(list_transform(range(1,"
    " j+1), lambda i: greatest(acc[i], h[i] + case when i > 1 then acc[i-1] else 0 end))))::INTEGER[]))::DOUBLE/len(a) end"
    " score from m)"
)


@query("rouge_recall", with_views("select prompt_id, gen, round(score, 6) score from r", "v_generations", extra=ROUGE))
def rouge_recall(t: Tables) -> DataFrame:
    return extraction.scores(t.generations).select("prompt_id", "gen", rounded("score").alias("score"))


@query(
    "detail_extraction",
    with_views(
        "select prompt_id, gen, prompt || ' now ' query, generation, round(score, 6) score from r",
        "v_generations",
        extra=ROUGE,
    ),
)
def detail_extraction(t: Tables) -> DataFrame:
    rows = extraction.scores(t.generations)
    shown = extraction.trigger_query(F.col("prompt"), "now").alias("query")
    return rows.select("prompt_id", "gen", shown, "generation", rounded("score").alias("score"))


@query(
    "leakage_at_k",
    with_views(
        "select k::INTEGER k, round(count(*) filter (where first_leak <= k)/count(*), 6) leakage from (select prompt_id,"
        " min(gen) filter (where score > 0.9) first_leak from r group by prompt_id), range(1, 4) ks(k) group by k",
        "v_generations",
        extra=ROUGE,
    ),
)
def leakage_at_k(t: Tables) -> DataFrame:
    shares = extraction.leakage_at_k(extraction.scores(t.generations), 3)
    return shares.withColumn("leakage", rounded("leakage"))


# -- memorisation -----------------------------------------------------------------------------

VERDICT = (
    "v as (select doc_id, token_ids, generated, case when len(token_ids) < 50 then 'too_short' when len(generated[1:25])"
    " != 25 then 'generation_length_mismatch' when generated[1:25] = token_ids[26:50] then 'memorized' else"
    " 'tokens_mismatch' end verdict from v_memorize)"
)


@query(
    "memorization_candidates",
    with_views(
        "select doc_id, array_to_string(token_ids[1:25], ',') prefix, array_to_string(token_ids[26:50], ',') target from"
        " v_memorize where len(token_ids) >= 50",
        "v_memorize",
    ),
)
def memorization_candidates(t: Tables) -> DataFrame:
    rows = memorization.candidates(t.memorize)
    return rows.select("doc_id", joined("prefix").alias("prefix"), joined("target").alias("target"))


@query("memorization_verdicts", with_views("select doc_id, verdict from v", "v_memorize", extra=VERDICT))
def memorization_verdicts(t: Tables) -> DataFrame:
    return memorization.verdicts(t.memorize).select("doc_id", "verdict")


@query(
    "memorization_summary",
    with_views(
        "select count(*) filter (where verdict='memorized') num_memorized_sequences, count(*) filter (where verdict like"
        " '%mismatch') num_non_memorized, count(*) filter (where verdict='generation_length_mismatch')"
        " num_length_mismatch, count(*) filter (where verdict='tokens_mismatch') num_tokens_mismatch, count(*) filter"
        " (where verdict='too_short') num_too_short, count(*) num_total from v",
        "v_memorize",
        extra=VERDICT,
    ),
)
def memorization_summary(t: Tables) -> DataFrame:
    return memorization.summary(t.memorize)


# -- metrics -----------------------------------------------------------------------------


@query(
    "metric_filter",
    with_views(
        "select event_id, task_name, metric, mval::DOUBLE as value from v_metric_rows where kind in ('UBIGINT','BIGINT',"
        "'DOUBLE') and regexp_matches(metric, 'score|^acc')",
        "v_metric_rows",
    ),
)
def metric_filter(t: Tables) -> DataFrame:
    return metrics.keep_metrics(metrics.flatten_metrics(t.metric_files), "score|^acc")


@query(
    "metric_names",
    with_views(
        "select event_id, case when metric='primary_score' then 'olmes/'||task_name else 'olmes/'||task_name||'/'||metric"
        " end as key, case when event_id%2=0 then 'a/'||metric else 'evaluation/'||task_name||'/'||metric end logged,"
        " 'control/'||task_name||'_'||metric control from v_metric_rows",
        "v_metric_rows",
    ),
)
def metric_names(t: Tables) -> DataFrame:
    rows = metrics.flatten_metrics(t.metric_files)
    task, metric = F.col("task_name"), F.col("metric")
    own = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a/"), metric)).otherwise(metric)
    return rows.select(
        "event_id",
        metrics.task_key(task, metric).alias("key"),
        metrics.logged_key(task, own).alias("logged"),
        metrics.control_key(task, metric).alias("control"),
    )


@query(
    "metric_store",
    with_views(
        "select event_id // 100 step, task_name evaluation, metric, mval::DOUBLE as value from v_metric_rows where kind in"
        " ('UBIGINT','BIGINT','DOUBLE')",
        "v_metric_rows",
    ),
)
def metric_store(t: Tables) -> DataFrame:
    """Metric rows stored twice under one write id: the second write replaces the first."""
    from inlay.staging import new_path

    rows = metrics.keep_metrics(metrics.flatten_metrics(t.metric_files), "").select(
        F.floor(F.col("event_id") / 100).alias("step"), F.col("task_name").alias("evaluation"), "metric", "value"
    )
    path = new_path(t.spark, "metric-rows")
    for _ in range(2):
        metrics.store_metrics(rows, path, "all")
    return t.spark.read.schema(metrics.METRIC_SCHEMA).parquet(path).drop("write_id")


@query(
    "evaluation_rollup",
    with_views(
        "select 'questions' evaluation, 'acc' metric, round(count(*) filter (where not failed and picked=labelled)"
        "/(max(doc_id)+1), 6) as value, 4 succeeded, 5 requested from best union all select 'questions', 'n_present',"
        " count(*), 4, 5 from best union all select 'questions', 'n_failed', count(*) filter (where failed), 4, 5 from best"
        f" union all select 'prompts', 'cross_entropy_loss', round({PPL}, 6), 4, 5 from d union all select 'prompts',"
        f" 'perplexity', round(exp({PPL}), 6), 4, 5 from d union all select 'sums', 'acc', round(avg(coalesce("
        "parsed=answer, false)::INTEGER), 6), 4, 5 from parsed where ops=1 union all"
        " select 'verbatim', unnest(['num_memorized_sequences','num_non_memorized','num_length_mismatch',"
        "'num_tokens_mismatch','num_too_short','num_total']), unnest([count(*) filter (where verdict='memorized'),"
        " count(*) filter (where verdict like '%mismatch'), count(*) filter (where"
        " verdict='generation_length_mismatch'), count(*) filter (where verdict='tokens_mismatch'), count(*) filter"
        " (where verdict='too_short'), count(*)])::DOUBLE, 4, 5 from v",
        "v_choices",
        "v_prompts_scored",
        "v_math",
        "v_memorize",
        extra=", ".join([rc_picks("raw"), DISTINCT, MATH, VERDICT]),
    ),
)
def evaluation_rollup(t: Tables) -> DataFrame:
    """Five evaluations of one step, one of which fails because its rows lack a column."""
    requests = [
        registry.Request("questions", "ranked_choice", t.choices),
        registry.Request("prompts", "perplexity", t.prompts_scored),
        registry.Request("sums", "arithmetic", t.math, {"ops": 1}),
        registry.Request("verbatim", "memorization", t.memorize),
        registry.Request("broken", "knowledge", t.math),
    ]
    report = registry.run_all(t.spark, requests, step=0)
    return report.metrics.select(
        "evaluation",
        "metric",
        rounded("value").alias("value"),
        F.lit(report.succeeded).alias("succeeded"),
        F.lit(report.requested).alias("requested"),
    )


# -- plug-ins -----------------------------------------------------------------------------

BIGRAM = (
    "grams as (select prev, next, count(*) n from (select unnest(tokens[1:-2]) prev, unnest(tokens[2:]) as next from"
    " v_doc_tokens where len(tokens) > 1) group by all), heads as (select prev, sum(n) total from grams group by prev),"
    " vocab as (select count(distinct t) v from (select unnest(tokens) t from v_doc_tokens))"
)


@query(
    "bigram_logprobs",
    with_views(
        "select seq_id query_id, string_agg(round(lp, 6)::VARCHAR, ',' order by at_) logprobs, count(*) n from (select"
        " s.seq_id, s.at_, ln((coalesce(g.n, 0)+1)/(coalesce(h.total, 0)+(select v from vocab))) lp from (select seq_id,"
        " unnest(tokens[1:-2]) prev, unnest(tokens[2:]) as next, unnest(range(1, len(tokens))) as at_ from v_insert_tokens)"
        " s left join grams g on g.prev=s.prev and g.next=s.next left join heads h on h.prev=s.prev) group by seq_id",
        "v_doc_tokens",
        "v_insert_tokens",
        extra=BIGRAM,
    ),
)
def bigram_logprobs(t: Tables) -> DataFrame:
    """Benchmark items scored by bigram counts of the documents."""
    model = BigramModel.train(t.doc_tokens)
    prompts = t.insert_tokens.select(F.col("seq_id").alias("query_id"), F.col("tokens").alias("token_ids"))
    tail = F.slice("logprobs", F.lit(2), F.size("logprobs"))
    return model.score(prompts).select(
        "query_id",
        F.array_join(F.transform(tail, lambda v: F.round(v, 6).cast("string")), ",").alias("logprobs"),
        F.size(tail).cast("bigint").alias("n"),
    )


@query(
    "bigram_generate",
    with_views(
        "select doc_id query_id, array_to_string(out, ',') generated from (select doc_id, arg_max(out, len(out)) out from"
        " walk group by doc_id)",
        "v_doc_tokens",
        extra=BIGRAM
        + ", best as (select prev, arg_max(next, n*10000000000-next) nxt from grams group by prev),"
        " walk as (select doc_id, tokens[-1] last, []::INTEGER[] out from v_doc_tokens union all select w.doc_id, b.nxt,"
        " list_append(w.out, b.nxt) from walk w join best b on b.prev=w.last where len(w.out) < 25)",
        recursive=True,
    ),
)
def bigram_generate(t: Tables) -> DataFrame:
    """Every document continued greedily by 25 tokens."""
    model = BigramModel.train(t.doc_tokens)
    prompts = t.doc_tokens.select(F.col("doc_id").alias("query_id"), F.col("tokens").alias("token_ids"))
    return model.generate(prompts, 25).select("query_id", joined("generated").alias("generated"))


_U = "(('0x'||substr(md5(concat_ws(':',{s},vec_id,i,'{t}')),1,15))::BIGINT::DOUBLE+1)/1152921504606846977.0::DOUBLE"


@query(
    "gaussian_perturb",
    with_views(
        "select vec_id, batch, array_to_string(list_transform(list_transform(range(0, len(embedding)), lambda i: case when"
        " batch%3=0 then embedding[i+1]::DOUBLE + {std}*(sqrt(-2*ln({u}))*cos(6.283185307179586*{v})) else"
        " embedding[i+1]::DOUBLE end), lambda x: round(x*1000000)::BIGINT), ',') micros from v_embed".format(
            std=NOISE_STD, u=_U.format(s=SEED, t="u"), v=_U.format(s=SEED, t="v")
        ),
        "v_embed",
    ),
)
def gaussian_perturb(t: Tables) -> DataFrame:
    """Every third batch perturbed; values in millionths."""
    vectors = t.embed
    noisy = perturb(vectors, vectors.where("batch % 3 = 0").select("batch"), SEED)
    micros = F.transform("embedding", lambda x: F.round(x * 1000000).cast("bigint"))
    return noisy.select("vec_id", "batch", joined(micros).alias("micros"))
