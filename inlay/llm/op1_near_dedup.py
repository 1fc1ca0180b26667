"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of ``width`` words.  Registers are minima of
exponential values over the set, truncated to powers of ``BASE``: sketches of two sets merge
by taking maxima, and equal registers grow with the Jaccard similarity.  Bands of
registers propose pairs, the likelihood of the register comparisons, given the exact set
sizes, discards those that cannot be similar, and the rest is confirmed on full sets.

Documents of equal sets form a class first, so copies meet no band.  Inside a band's
bucket no pairs are listed: rounds test every member against one leader, found links join
components, and what a leader left in another component is tested against the members it
is not joined to.  So links may stay untested only inside one component.

A text without words has an empty set and is linked with nothing, like rows whose id is
null.  Rows of one id and different texts are documents of their own, told apart by hashes of
the text; rows of equal id and text stand or fall together.  Of documents that tie for the
smallest id of a component all are kept.  Very long texts are read whole, one in a block of its own.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import free_name, materialize, table
from inlay.llm.components import components
from inlay.llm.words import Block, blocks, mix, rolling, split

BASE, RATE, TOP = 1.001, 20.0, 65535
BAND, BANDS = 4, 32
REGISTERS = BAND * BANDS
SIMILAR = 80  # percent
ROUNDS = 2  # leader rounds before the rest of a bucket is tested
BUCKET_ROWS = 50_000  # larger buckets are tested in several tasks
HOME_ROWS = 256  # documents that are compared as one block
DOUBT = 18.0  # log-likelihood by which a pair must miss the threshold to be discarded
MARKS = ["m0", "m1"]  # tell the texts of one id apart
SKETCHES = "doc_id bigint, n_shingles bigint, digest binary, sketch binary, m0 bigint, m1 bigint"

_draws = np.random.default_rng(90_001)
_FACTORS = _draws.integers(0, 1 << 63, REGISTERS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draws.integers(0, 1 << 63, REGISTERS, np.int64).astype(np.uint64) * np.uint64(2)


def shingle_sets(block: Block, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one where there are fewer than ``width``."""
    words = split(block)
    runs = rolling(words.hashes, width)
    out = []
    for i in range(len(block)):
        first, last = int(words.at[i]), int(words.at[i + 1])
        if last - first >= width:
            out.append(np.unique(runs[first : last - width + 1]))
        elif last > first:
            out.append(mix(rolling(words.hashes[first:last], last - first) + np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore", divide="ignore"):
        for at in range(0, len(shingles), 256):
            values = shingles[at : at + 256, None] * _FACTORS
            values += _SHIFTS
            np.minimum(least, values.min(axis=0), out=least)
        minima = -np.log1p(-((least >> np.uint64(11)) * 2.0**-53)) / RATE
        return np.clip(np.floor(1.0 - np.log(minima) / np.log(BASE)), 0, TOP).astype(np.uint16)


def marks_of(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("m0"), F.xxhash64(text, F.lit(1)).alias("m1")]


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``SKETCHES`` of ``docs(doc_id, text)``; sets of equal digest are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for block in blocks(batch.column(1)):
                for found in shingle_sets(block, width):
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    sketches.append(registers(found).tobytes() if len(found) else None)
            arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())]
            columns = [batch.column(0), *arrays, batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "c", "d", "e", "f"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", *marks_of()).mapInArrow(run, SKETCHES)


def band_keys(classes: DataFrame) -> DataFrame:
    """``(band, rep, n)``: one row per band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                sketches = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(-1, BANDS)
                with np.errstate(over="ignore"):
                    keys = mix(mix(sketches) + np.arange(BANDS, dtype=np.uint64))
                rows = np.repeat(np.arange(part.num_rows), BANDS)
                arrays = [pa.array(keys.view(np.int64).ravel()), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))]
                yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "c"])

    return classes.select("rep", "n", "sketch").mapInArrow(run, "band bigint, rep bigint, n bigint")


def log_likelihood(more: np.ndarray, less: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of Jaccard ``j`` for counts of larger and smaller registers; ``u`` is the first set's share of both sizes."""

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    a, b = p(u - (1 - u) * j), p((1 - u) - u * j)
    tiny = 1e-300
    with np.errstate(divide="ignore"):
        return more * np.log(a + tiny) + less * np.log(b + tiny) + (REGISTERS - more - less) * np.log(np.maximum(1 - a - b, tiny))


def may_be_similar(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similar: int) -> np.ndarray:
    """Whether pairs of register rows are not clearly below the threshold."""
    more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    u = (nx / (nx + ny))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0.0, 1.0, 101)[None, :] * most
    best = log_likelihood(more, less, u, grid).max(axis=1)
    reach = similar / 100 + (most - similar / 100) * np.linspace(0.0, 1.0, 21)[None, :]
    there = log_likelihood(more, less, u, np.minimum(reach, most)).max(axis=1)
    return (100 * np.minimum(nx, ny) >= similar * np.maximum(nx, ny)) & (there >= best - DOUBT)


def estimated(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """``pairs(a, b)`` whose likelihood does not exclude the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (4, 5))
                nx, ny = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (2, 3))
                yield part.select([0, 1]).filter(pa.array(may_be_similar(x, y, nx, ny, similar)))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return met.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similar: int) -> DataFrame:
    """``pairs(a, b)`` that are similar on full sets; ``texts(rep, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                x = [s for block in blocks(part.column(2)) for s in shingle_sets(block, width)]
                y = [s for block in blocks(part.column(3)) for s in shingle_sets(block, width)]
                for p, q in zip(x, y):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= similar * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.selectExpr("rep b", "text tb"), "b")
    met = with_b.join(texts.selectExpr("rep a", "text ta"), "a")
    return met.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def likely_in_buckets(rows: DataFrame, similar: int) -> DataFrame:
    """``(x, y)``: homes of bucket members in different components that may be similar.

    ``rows(band, part, home, label, n, asks, offers, sketch)``: members that ask are compared
    with those that offer.  The pairs are looked at inside the task; what leaves it are the
    homes (blocks of some hundred documents) of those whose registers agree enough.
    """
    draws = np.arange(REGISTERS + 1) / REGISTERS
    share = similar / 100
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.nan_to_num(draws * np.log(draws / share)) + np.nan_to_num((1 - draws) * np.log((1 - draws) / (1 - share)))
    # equal registers are at least as likely as the similarity: a Chernoff bound excludes fewer than this
    fewest = int(np.flatnonzero((draws >= share) | (REGISTERS * gap <= DOUBT))[0])

    def pairs_of(x: dict) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        starts = np.concatenate([[0], np.flatnonzero((x["band"][1:] != x["band"][:-1]) | (x["part"][1:] != x["part"][:-1])) + 1])
        for first, last in zip(starts, np.append(starts[1:], len(x["band"]))):
            asking = first + np.flatnonzero(x["asks"][first:last])
            offered = first + np.flatnonzero(x["offers"][first:last])
            step = max(1, (1 << 20) // max(1, len(offered)))
            for at in range(0, len(asking), step):
                some = asking[at : at + step]
                na, nb = x["n"][some][:, None], x["n"][offered][None, :]
                apart = (x["label"][some][:, None] != x["label"][offered][None, :]) & (
                    100 * np.minimum(na, nb) >= similar * np.maximum(na, nb)
                )
                a, b = np.nonzero(apart)
                a, b = some[a], offered[b]
                for k in range(0, len(a), 4096):
                    p, q = a[k : k + 4096], b[k : k + 4096]
                    equal = (x["sketch"][p] == x["sketch"][q]).sum(axis=1) >= fewest
                    p, q = p[equal], q[equal]
                    if len(p):
                        good = may_be_similar(x["sketch"][p], x["sketch"][q], x["n"][p].astype(float), x["n"][q].astype(float), similar)
                        seen.append(np.unique(np.stack([x["home"][p[good]], x["home"][q[good]]], axis=1), axis=0))
        homes = np.unique(np.concatenate(seen), axis=0)
        if len(homes):
            yield pa.RecordBatch.from_arrays([pa.array(homes[:, 0]), pa.array(homes[:, 1])], ["x", "y"])

    def arrays_of(batches: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(batches)
        x = {c: t.column(c).to_numpy() for c in ("band", "part", "home", "label", "n", "asks", "offers")}
        return x | {"sketch": np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                band, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                change = np.flatnonzero((band != band[-1]) | (part != part[-1]))
                if len(change):  # the last list may go on in the next batch
                    cut = int(change[-1]) + 1
                    yield from pairs_of(arrays_of([*held[:-1], batch.slice(0, cut)]))
                    held = [batch.slice(cut)]
        if held:
            yield from pairs_of(arrays_of(held))

    columns = ["band", "part", "home", "label", "n", "asks", "offers", "sketch"]
    ordered = rows.select(*columns).repartition("band", "part").sortWithinPartitions("band", "part")
    return ordered.mapInArrow(run, "x bigint, y bigint").distinct()


def homes_of(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """``(rep, label, home)`` for all members of mixed buckets: blocks of about ``HOME_ROWS`` similar documents."""
    rows = placed.join(mixed, "band")
    asked = F.min(F.when(F.col("label") != F.col("lead.label"), F.col("lead.label")))
    near = rows.groupBy("rep").agg(F.min("label").alias("label"), asked.alias("near"))
    near = near.withColumn("near", F.coalesce("near", "label"))
    sizes = near.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / HOME_ROWS).alias("homes"))
    own = F.xxhash64("near", F.pmod(F.xxhash64("rep"), F.col("homes")))
    return near.join(sizes, "near").select("rep", "label", own.alias("home"))


def bucket_lists(placed: DataFrame, mixed: DataFrame, homes: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components; large buckets are cut into parts that all askers visit."""
    rows = placed.join(mixed, "band")
    asks = F.col("label") != F.col("lead.label")
    parts = F.ceil(F.col("held") / BUCKET_ROWS).cast("int")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    here = F.when(asks, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    rows = rows.select("band", "rep", "label", "n", asks.alias("asks"), own.alias("own"), F.explode(here).alias("part"))
    rows = rows.withColumn("offers", F.col("part") == F.col("own"))
    return rows.join(members.select("rep", "sketch").join(homes.select("rep", "home"), "rep"), "rep")


def links_between(pairs: DataFrame, homes: DataFrame, bodies: DataFrame, width: int, similar: int) -> DataFrame:
    """Links ``(a, b)`` between the documents of the homes ``pairs(x, y)``, on full sets.

    A document needs one link to a component: of several, the first is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (opened(batch.column(c)[i].as_py()) for c in (0, 1))
                out = list(between(x, y))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    def opened(rows: list[dict]) -> tuple[list, list, list]:
        sets = [s for block in blocks(pa.array([r["text"] for r in rows], pa.string())) for s in shingle_sets(block, width)]
        return [r["rep"] for r in rows], [r["label"] for r in rows], sets

    def between(x: tuple, y: tuple) -> Iterator[tuple[int, int]]:
        reps, labels, sets = x
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        size = np.array([len(s) for s in sets])
        for rep, label, own in zip(*y):
            low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            done: set[int] = set()
            for k in np.flatnonzero(100 * both >= similar * (size + len(own) - both)).tolist():
                if labels[k] != label and labels[k] not in done:
                    done.add(labels[k])
                    yield min(rep, reps[k]), max(rep, reps[k])

    content = bodies.join(homes, "rep").groupBy("home").agg(F.collect_list(F.struct("rep", "label", "text")).alias("rows"))
    content = materialize(content, "homes")
    met = pairs.join(content.selectExpr("home x", "rows xs"), "x").join(content.selectExpr("home y", "rows ys"), "y")
    return met.select("xs", "ys").mapInArrow(run, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, width: int = 2, similar: int = SIMILAR, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    return marked(docs, width, similar, rounds).drop(*MARKS)


def marked(docs: DataFrame, width: int, similar: int, rounds: int = ROUNDS) -> DataFrame:
    """:func:`linked` with the marks of each row's text."""
    spark = docs.sparkSession
    sketches = materialize(sketched(docs, width), "sketches")
    some = sketches.where("doc_id is not null and n_shingles > 0")
    # one row per class of equal sets, with its smallest id; ids may repeat, so classes are numbered
    row = F.struct(F.col("doc_id").alias("first"), *MARKS, F.col("n_shingles").alias("n"), "sketch")
    smallest = F.min_by(row, F.struct("doc_id", *MARKS)).alias("c")
    classes = some.groupBy("digest").agg(smallest).select("digest", "c.*")
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # smaller sets can only be similar to equal ones
    least = -(-similar // (100 - similar)) if similar < 100 else 1 << 40
    bands = band_keys(classes.where(F.col("n") >= least))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("band")
    buckets = materialize(bands.join(shared.hint("merge"), "band"), "buckets")
    met = buckets.select("rep").distinct()
    members = materialize(classes.join(met, "rep", "left_semi").select("rep", "n", "sketch"), "members")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("first"), "text", *marks_of())
    # the same join at every size: a corpus' texts move once, those of bucket members are stored
    owners = classes.join(met, "rep", "left_semi").select("first", *MARKS, "rep")
    bodies = texts.join(owners.hint("merge"), ["first", *MARKS]).dropDuplicates(["first", *MARKS])
    bodies = materialize(bodies.select("rep", "text"), "bodies")
    links = spark.createDataFrame([], "a bigint, b bigint")
    labels = spark.createDataFrame([], "node bigint, label bigint")
    for number in range(rounds + 1):
        placed = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        placed = placed.withColumn("label", F.coalesce("label", "rep"))
        turn = F.struct(F.xxhash64("rep", F.lit(number)).alias("turn"), "rep", "label", "n")
        ends = F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("held")
        mixed = placed.groupBy("band").agg(F.max(turn).alias("lead"), *ends).where("l0 != l1").select("band", "lead", "held")
        if number < rounds:
            apart = placed.join(mixed, "band").where(F.col("label") != F.col("lead.label"))
            apart = apart.where(sizes_agree("n", "lead.n", similar))
            pairs = apart.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
            likely = estimated(pairs, members, similar)
            likely = materialize(likely, "likely")
            found = materialize(confirmed(likely, bodies, width, similar), "links")
        else:
            # what no leader reached, against all members it is not joined to
            homes = materialize(homes_of(placed, mixed), "homes")
            likely = likely_in_buckets(bucket_lists(placed, mixed, homes, members), similar)
            found = materialize(links_between(materialize(likely, "likely"), homes, bodies, width, similar), "links")
        links = links.unionByName(found)
        labels = components(links)
    firsts = labels.join(classes.selectExpr("rep node", "first"), "node").groupBy("label").agg(F.min("first").alias("least"))
    least = labels.join(firsts, "label").selectExpr("node rep", "least")
    owner = classes.select("digest", "rep", "first").join(least, "rep", "left")
    owner = owner.select("digest", F.coalesce("least", "first").alias("least"))
    held = F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")
    out = sketches.select("doc_id", "n_shingles", held, *MARKS).join(owner, "digest", "left")
    component = F.coalesce("least", "doc_id")
    kept = F.col("doc_id").eqNullSafe(component).alias("kept")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept, *MARKS)


def sizes_agree(x: str, y: str, similar: int):
    return 100 * F.least(x, y) >= similar * F.greatest(x, y)


def keep_first(docs: DataFrame, width: int = 5, similar: int = SIMILAR) -> DataFrame:
    """``docs`` without all but the smallest id of each component, with all columns."""
    own = [free_name(docs, m) for m in MARKS]
    gone = marked(docs, width, similar).where(~F.col("kept")).select("doc_id", *[F.col(m).alias(o) for m, o in zip(MARKS, own)])
    told = docs.withColumns(dict(zip(own, marks_of())))
    return told.join(gone.distinct(), ["doc_id", *own], "left_anti").select(*docs.columns)


@queries.query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents", "doc_id", "text"), width=2)
