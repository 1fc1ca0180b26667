"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Null and empty texts have no words and fail.  Rows are judged one by one, so repeated
rows get equal verdicts, an empty table stays empty, and other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import free_name, table
from inlay.llm.words import SPACES, folded, word_array

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in that is with for was on as at this an are "
    "der die das und zu den von ist ein eine mit auf für im sich des "
    "le la les et de un une est que du en des pour dans il ne "
    "el los las y una por con del se al lo su para es no"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Holds where ``low * of <= 100 * part <= high * of``; a bound of None is open."""

    name: str
    part: str
    of: str | int
    low: int | None = None
    high: int | None = None


BASE = (
    Rule("few_words", "n_words", 1, low=5000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("shouting", "n_marks", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first occurrence included."""

    def covered(at: Column) -> Column:
        # a repeated window adds the words up to the next one, three at most
        gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def neighbours(placed: Column) -> Column:
        def same(p: Column, i: Column) -> Column:
            before, after = F.get(placed, i - 1)["w"] == p["w"], F.get(placed, i + 1)["w"] == p["w"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        at = F.transform(F.filter(placed, same), lambda p: p["i"])
        return let(F.sort_array(at), covered)

    def found(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, neighbours)).otherwise(0)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) > 3, let(windows, found)).otherwise(0)


def counts_of(text: str) -> Column:
    """Struct of the counts that rules may use."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def removed(chars: str) -> Column:
        return (F.length(whole) - F.length(F.translate(whole, chars, ""))).cast("bigint")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            repeated_words(words).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: folded(w).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    return F.struct(
        let(word_array(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(whole, SPACES, "")).cast("bigint").alias("word_chars"),
        removed(SYMBOLS).alias("n_symbols"),
        removed("!").alias("n_marks"),
    )


def measured(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with a struct ``into`` of the counts."""
    names = ("word_chars", "n_symbols", "n_marks")
    flat = df.withColumn(into, counts_of(text))
    return flat.withColumn(into, F.struct(f"{into}.w.*", f"{into}.l.*", *[f"{into}.{c}" for c in names]))


def verdict(rules: tuple[Rule, ...], counts: str) -> Column:
    """True where all rules hold for the struct column ``counts``."""
    held = F.lit(True)
    for rule in rules:
        part = 100 * F.col(f"{counts}.{rule.part}")
        of = F.lit(rule.of).cast("bigint") if isinstance(rule.of, int) else F.col(f"{counts}.{rule.of}")
        if rule.low is not None:
            held = held & (part >= rule.low * of)
        if rule.high is not None:
            held = held & (part <= rule.high * of)
    return held


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality") -> DataFrame:
    """``df`` with a struct ``into``: the counts, ``base_failed`` and ``kept``."""
    into = free_name(df, into)
    counted = measured(df, text, into)
    failed = ~verdict(BASE, into)
    return counted.withColumn(
        into, F.struct(f"{into}.*", failed.alias("base_failed"), (~failed & verdict(rules, into)).alias("kept"))
    )


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``df`` whose text the rules keep, with the columns of ``df``."""
    into = free_name(df, "quality")
    return judged(df, text, rules, into).where(f"{into}.kept").drop(into)


def _sql_rule(rule: Rule) -> str:
    of = str(rule.of)
    bounds = [f"100*{rule.part} >= {rule.low}*{of}"] if rule.low is not None else []
    bounds += [f"100*{rule.part} <= {rule.high}*{of}"] if rule.high is not None else []
    return " and ".join(bounds)


# Counts per document in DuckDB; {docs} is the input relation.
COUNTS_SQL = """
q_words as (select doc_id, coalesce("text", '') as body,
  list_filter(regexp_split_to_array(coalesce("text", ''), '[\\x20\\x09-\\x0D]+'), lambda w: w != '') as words,
  list_filter(string_split(coalesce("text", ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from {docs}),
q_grams as (select *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) as grams
  from q_words),
q_pairs as (select *, list_sort(list_transform(range(1, len(grams) + 1), lambda i: {{'g': grams[i], 'i': i}})) as s from q_grams),
q_at as (select *, list_sort(list_transform(list_filter(range(1, len(s) + 1),
  lambda k: (k > 1 and s[greatest(k-1, 1)].g = s[k].g) or (k < len(s) and s[least(k+1, len(s))].g = s[k].g)), lambda k: s[k].i)) as places
  from q_pairs),
q_counts as (select doc_id, body, len(words)::bigint as n_words,
  length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
  (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols,
  (length(body) - length(replace(body, '!', '')))::bigint as n_marks,
  len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(list_sum(list_transform(range(1, len(places) + 1), lambda k: case when k = len(places) then 3
    else least(3, places[least(k+1, len(places))] - places[k]) end)), 0)::bigint as n_repeat_words,
  len(list_filter(words, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') in ({stops})))::bigint
    as n_stop_words from q_at),
q_judged as (select *, not ({base}) as base_failed, ({base}) and ({rules}) as kept from q_counts)"""


def counts_sql(docs: str = "documents") -> str:
    """CTEs ending in ``q_judged``: the counts and verdicts of ``docs``."""
    return COUNTS_SQL.format(
        docs=docs,
        stops=", ".join(f"'{w}'" for w in STOP_WORDS),
        base=" and ".join(map(_sql_rule, BASE)),
        rules=" and ".join(map(_sql_rule, RULES)),
    ).strip()


COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()


@queries.query("op10_quality_rules", f"with {counts_sql()} select {', '.join(COLUMNS)} from q_judged")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = judged(table(spark, folder, "documents", "doc_id", "text"), into="quality")
    return out.select("doc_id", *[f"quality.{c}" for c in COLUMNS[1:]])
