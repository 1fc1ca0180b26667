"""Secret scan: candidate strings, and a random forest that sorts out the false ones.

Candidates are runs of ``MIN_LENGTH`` or more characters of keys and tokens.  The forest sees
their length, character classes and transitions (against a bigram model of the corpus' own
words), how much of them dictionary pieces cover, the document's path, and the words around.  It
is fitted to labelled findings, of which at most ``LABELLED`` are used; counts behind the features
cover all words of all documents.  Everything is built-in functions and the DataFrame
machine-learning API.

Without labels of its own a corpus is labelled by rule: quoted values that a name of a secret
is assigned to are real, runs without digits whose pieces the dictionary covers are not;
other candidates are left to the forest.  If either kind is missing, all findings get the share
of real ones among the labelled (none: 0).  Null and empty texts have no candidates; repeated
rows repeat their findings; an empty table has none; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import materialize, table
from inlay.llm.op10_quality import let
from inlay.llm.words import word_array

MIN_LENGTH = 16
RUN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % MIN_LENGTH
NAMES = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer)"
LABELLED = 20_000
TREES, DEPTH, SEED = 20, 5, 17
PIECE = 4  # letters of a dictionary piece
PIECE_WORDS = 3  # distinct words that make a piece one of the dictionary
FEATURES = (
    "n_chars shape_share distinct_share digit_share upper_share transition coverage path_parts path_sample named"
    " assigned quoted before_chars after_chars"
).split()


def findings(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id, position, finding, path, before, after, word``: every candidate with what surrounds it."""

    def around(words: Column) -> Column:
        places = F.filter(
            F.transform(words, lambda w, i: F.when((F.length(w) >= MIN_LENGTH) & w.rlike(RUN), i)), lambda i: i.isNotNull()
        )
        return F.transform(
            places,
            lambda i: F.struct(
                i.cast("bigint").alias("position"),
                F.get(words, i).alias("word"),
                F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)).alias("before"),
                F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
            ),
        )

    found = docs.select("doc_id", F.coalesce(path, F.lit("")).alias("path"), F.explode(let(word_array(text), around)).alias("f"))
    # several runs in one word are findings of their own
    run = F.explode(F.regexp_extract_all("f.word", F.lit(RUN), F.lit(0))).alias("finding")
    return found.select("doc_id", "path", "f.*", run)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-case words without candidates, and their counts over all texts."""
    words = docs.select(F.explode(word_array(text)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    plain = words.where((F.length("w") < MIN_LENGTH) | ~F.col("w").rlike(RUN))
    return plain.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"))


def windows(column: str, size: int) -> Column:
    """All runs of ``size`` characters."""
    last = F.length(column) - size + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size)))


def transitions(words: DataFrame) -> DataFrame:
    """``pair, log_share``: how often the second letter follows the first, smoothed."""
    pairs = words.select(F.explode(windows("word", 2)).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    heads = pairs.groupBy(F.substring("pair", 1, 1).alias("head")).agg(F.sum("n").alias("total"))
    met = pairs.withColumn("head", F.substring("pair", 1, 1)).join(heads, "head")
    return met.select("pair", F.log10((F.col("n") + 1) / (F.col("total") + 64)).alias("log_share"))


def pieces(words: DataFrame) -> DataFrame:
    """Pieces that at least ``PIECE_WORDS`` distinct words have."""
    parts = words.select("word", F.explode(F.array_distinct(windows("word", PIECE))).alias("piece"))
    return parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PIECE_WORDS).select("piece")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with :data:`FEATURES`; what depends on the string alone is worked out once per string."""
    strings = found.select("finding").distinct().withColumn("low", F.lower("finding"))
    pair = F.explode(windows("low", 2)).alias("pair")
    flow = strings.select("finding", pair).join(transitions(words), "pair", "left")
    flow = flow.groupBy("finding").agg(F.avg(F.coalesce("log_share", F.lit(-4.0))).alias("transition"))
    known = pieces(words).withColumn("known", F.lit(1.0))
    cover = strings.select("finding", F.explode(windows("low", PIECE)).alias("piece")).join(known, "piece", "left")
    cover = cover.groupBy("finding").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage"))
    shape = F.col("finding")
    for kind, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[+/_=\-]+", "-")):
        shape = F.regexp_replace(shape, kind, sign)
    n = F.length("finding").cast("double")
    alone = strings.join(flow, "finding").join(cover, "finding").select(
        "finding", "transition", "coverage", n.alias("n_chars"),
        (F.length(shape) / n).alias("shape_share"),
        (F.size(F.array_distinct(F.split("finding", ""))) / n).alias("distinct_share"),
        (F.regexp_count("finding", F.lit("[0-9]")) / n).alias("digit_share"),
        (F.regexp_count("finding", F.lit("[A-Z]")) / n).alias("upper_share"),
    )
    lead = F.concat_ws(" ", "before", F.expr("substring_index(word, finding, 1)"))
    return found.join(alone, "finding").withColumns({
        "path_parts": F.size(F.split("path", r"[/._\-]")).cast("double"),
        "path_sample": F.lower("path").rlike("test|example|sample|doc").cast("double"),
        "named": lead.rlike(NAMES).cast("double"),
        "assigned": lead.rlike(r"[=:]\s*[\"']*\s*$").cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "before_chars": F.length("before").cast("double"),
        "after_chars": F.length("after").cast("double"),
    })


def rule_label() -> Column:
    """1 for a real secret, 0 for a false one, null where the rule doesn't say."""
    real = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("digit_share") > 0)
    false = (F.col("digit_share") == 0) & (F.col("coverage") >= 0.5) & (F.col("assigned") == 0)
    return F.when(real, 1.0).when(false, 0.0)


def sample_labelled(rows: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled findings, the first by a hash of place and string."""
    order = F.xxhash64("doc_id", "position", "finding")
    return rows.where("label is not null").orderBy(order, "doc_id", "position").limit(limit)


def judged(rows: DataFrame, labelled: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with ``probability`` and ``is_secret`` of a forest fitted to ``labelled(FEATURES, label)``."""
    kinds = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        chance = F.lit(float(next(iter(kinds), 0.0)))
        return rows.withColumn("probability", chance).withColumn("is_secret", chance >= 0.5)
    into = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", probabilityCol="shares", rawPredictionCol="raw",
        predictionCol="predicted", numTrees=TREES, maxDepth=DEPTH, seed=seed,
    )
    model = forest.fit(into.transform(labelled.select(*FEATURES, "label")))
    out = model.transform(into.transform(rows))
    share = vector_to_array("shares")[1]
    return out.withColumn("probability", share).withColumn("is_secret", share >= 0.5).drop("features", "shares", "raw", "predicted")


def scanned(docs: DataFrame, labels: DataFrame | None = None, limit: int = LABELLED) -> DataFrame:
    """Findings of ``docs`` with features, probability and verdict.

    ``labels(doc_id, position, finding, label)`` are findings judged by hand; without them the rule labels.
    """
    found = materialize(findings(docs), "findings")
    words = materialize(word_counts(docs), "words")
    rows = described(found, words)
    if labels is None:
        rows = rows.withColumn("label", rule_label())
    else:
        rows = rows.join(labels.select("doc_id", "position", "finding", "label"), ["doc_id", "position", "finding"], "left")
    rows = materialize(rows, "described")
    return judged(rows, sample_labelled(rows, limit))


@queries.query("op8_secrets")
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    out = scanned(table(spark, folder, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "position", "finding", *FEATURES, "label", "probability", "is_secret")
