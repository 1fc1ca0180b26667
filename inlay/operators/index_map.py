"""The stored index map: Parquet rows ``(index, ordinal, pos, tokens)`` and its offset-array form."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inlay.functions.tokens import int_div
from inlay.operators.map_log import Conflict, MapLog, Run, State, touched_buckets
from inlay.operators.reindex import PAGE, nest
from inlay.operators.scan import grouped_ordinal, ordered_scan
from inlay.operators.skew import spread_join
from inlay.staging import materialize

SCHEMA = "index bigint, ordinal bigint, pos int, tokens array<int>"
STORED = SCHEMA + ", write_id string"
LOAD = "load"  # write_id of a plain overwrite
ATTEMPTS = 20  # of a write that others overtake
REBUILT = 4  # level of counters that were worked out from stored rows
OFFSET_BLOCK = 1 << 16
TOKEN_BLOCK = 1024  # tokens that move together when lists are put together again
POINT_PROBES = 1000  # probes up to which files are chosen by the zone table
ZONE_INDICES = 4096  # indices of a file that share one bitmap
ZONE_BITS = 1 << 15
ZONES = "file string, lo bigint, hi bigint, segments bigint, segment bigint, bits binary"


def zone_name(file: str) -> str:
    """Folder and name of a file, which is the same however its path is written."""
    return "/".join(file.split("/")[-2:])


def zone_segment(index: Column, segments: Column) -> Column:
    return F.pmod(F.xxhash64(index), segments)


def zone_bit(index: Column, n: int) -> Column:
    """Place of an index in the bitmap of its segment, by the ``n``-th hash."""
    return F.pmod(F.xxhash64(index, F.lit(n)), F.lit(ZONE_BITS).cast("bigint"))


def zone_holds(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1


def next_ordinals(rows: DataFrame) -> DataFrame:
    """``(index, held)``: the next free ordinal of each index."""
    return rows.groupBy("index").agg((F.max("ordinal") + 1).alias("held"))


@dataclass
class IndexMap:
    """A stored map at ``path``; every write fills a folder of its own.

    A folder belongs to the map once a commit record names it (see ``map_log``), so readers
    see a write as a whole or not at all.  Writing the same ``write_id`` again replaces that write and
    nothing else, so a retried append cannot add its rows twice.  An append reads the counters
    of the index buckets it touches; stored rows are read only for a write that
    replaces one whose counters were folded, and for the first append to rows that were never counted.
    """

    spark: SparkSession
    path: str

    @property
    def log(self) -> MapLog:
        return MapLog(self.spark, self.path)

    def overwrite(self, rows: DataFrame) -> None:
        """Replace the whole map by ``rows(index, ordinal, pos, tokens)``."""
        folder = self._write(rows, LOAD)
        for _ in range(ATTEMPTS):
            state = self.log.found()
            try:
                return self.log.commit(state, {LOAD: folder}, None, full=True)
            except Conflict:
                continue
        raise RuntimeError(f"{ATTEMPTS} other writes came first")

    def append(self, rows: DataFrame, order_by: list[str], write_id: str) -> None:
        """Add ``rows(index, pos, tokens, *order_by)`` behind what each index already holds.

        If another write commits first, the ordinals are worked out again behind it.
        """
        fresh = materialize(grouped_ordinal(rows, ["index"], order_by, "_new"), "fresh")
        buckets = touched_buckets(fresh)
        for _ in range(ATTEMPTS):
            state = self.log.found()
            runs = self._runs_without(state, write_id)
            counts = self.log.counts(runs, buckets).withColumnRenamed("held", "_held")
            held = spread_join(fresh, counts, ["index"], order_by, "left") if runs else fresh.withColumn("_held", F.lit(0))
            ordinal = (F.coalesce("_held", F.lit(0)) + F.col("_new")).alias("ordinal")
            folder = self._write(held.select("index", ordinal, "pos", "tokens"), write_id)
            own = self.log.write_run(next_ordinals(self._folder(folder)), 0, write_id)
            try:
                return self.log.commit(state, {write_id: folder}, [*self.log.folded(runs), own])
            except Conflict:
                continue
        raise RuntimeError(f"{ATTEMPTS} other writes came first")

    def _runs_without(self, state: State | None, write_id: str) -> list[Run]:
        """Runs that count all writes but one."""
        if state is None:
            return []
        known = state.runs is not None and (write_id not in state.folders or write_id in {r.write for r in state.runs})
        if known:
            return [r for r in state.runs if r.write != write_id]
        others = [f for w, f in state.folders.items() if w != write_id]
        return [self.log.write_run(next_ordinals(self._folder(*others)), REBUILT, None)] if others else []

    def _write(self, rows: DataFrame, write_id: str) -> str:
        """The name of a new folder with ``rows``."""
        folder = f"{write_id}.{uuid.uuid4().hex[:12]}"
        ranged = rows.select("index", "ordinal", "pos", "tokens").repartitionByRange("index", "ordinal")
        ranged.sortWithinPartitions("index", "ordinal").write.parquet(f"{self.path}/write_id={folder}")
        return folder

    def _folder(self, *names: str) -> DataFrame:
        read = self.spark.read.schema(STORED).option("basePath", self.path)
        return read.parquet(*[f"{self.path}/write_id={n}" for n in names])

    def _rows(self) -> DataFrame | None:
        state = self.log.found()
        return self._folder(*state.folders.values()) if state is not None and state.folders else None

    def rows(self) -> DataFrame:
        """All rows, flat."""
        stored = self._rows()
        if stored is None:
            return self.spark.createDataFrame([], SCHEMA)
        return stored.select("index", "ordinal", "pos", "tokens")

    def nested(self, page: int = PAGE) -> DataFrame:
        """All rows as ordered lists."""
        return nest(self.rows(), page)

    def indices(self) -> DataFrame:
        """Indices that hold insertions (reads one column)."""
        return self.rows().select("index").distinct()

    def has_index(self, probes: DataFrame) -> DataFrame:
        """Distinct probe indices with a ``has`` flag."""
        asked = probes.select("index").distinct()
        few = self._few(asked)
        present = self.indices() if few is None else self.point_rows(few).select("index").distinct()
        held = present.withColumn("_held", F.lit(True))
        return asked.join(held, "index", "left").select("index", F.coalesce("_held", F.lit(False)).alias("has"))

    def lookup(self, probes: DataFrame) -> DataFrame:
        """Flat insertions of the distinct probe indices; an absent index has one null row."""
        asked = probes.select("index").distinct()
        few = self._few(asked)
        rows = self.rows() if few is None else self.point_rows(few)
        found = rows.join(asked, "index", "left_semi")  # a long index may be split
        absent = asked.join(rows.select("index").distinct(), "index", "left_anti")
        return found.unionByName(absent, allowMissingColumns=True)

    def _zones(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(ZONES).parquet(f"{self.path}.zones")
        except Exception as error:  # no zone table yet
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def _few(self, asked: DataFrame) -> list[int] | None:
        """The probes, if there is a zone table and they are few."""
        if self._zones() is None:
            return None
        found = [r[0] for r in asked.where("index is not null").limit(POINT_PROBES + 1).collect()]
        return found if len(found) <= POINT_PROBES else None

    def note_files(self) -> None:
        """Add the files that the zone table does not know yet: range of indices, and hashed bitmaps of them."""
        stored = self._rows()
        if stored is None:
            return
        zones = self._zones()
        known = set() if zones is None else {r[0] for r in zones.select("file").distinct().collect()}
        fresh = [f for f in stored.inputFiles() if zone_name(f) not in known]  # names of files only
        if not fresh:
            return
        read = self.spark.read.schema(STORED).option("basePath", self.path).parquet(*fresh)
        held = read.select("index", F.substring_index("_metadata.file_path", "/", -2).alias("file")).distinct()
        segments = F.ceil(F.count(F.lit(1)) / F.lit(ZONE_INDICES)).alias("segments")
        spans = held.groupBy("file").agg(F.min("index").alias("lo"), F.max("index").alias("hi"), segments)
        bits = held.join(spans, "file").select(
            "file", "lo", "hi", "segments", zone_segment(F.col("index"), F.col("segments")).alias("segment"),
            F.explode(F.array(*[zone_bit(F.col("index"), n) for n in (1, 2)])).alias("at"),
        )
        keys = ["file", "lo", "hi", "segments", "segment"]
        made = bits.groupBy(*keys).agg(F.bitmap_construct_agg("at").alias("bits"))
        made.write.mode("append").parquet(f"{self.path}.zones")

    def files_of(self, probes: list[int]) -> list[str]:
        """Files that may hold one of a few indices; files that were never noted are among them."""
        stored = self._rows()
        if stored is None:
            return []
        files, zones = stored.inputFiles(), self._zones()
        if zones is None:
            return files

        def here(p: Column) -> Column:
            inside = p.between(F.col("lo"), F.col("hi")) & (zone_segment(p, F.col("segments")) == F.col("segment"))
            return inside & zone_holds(F.col("bits"), zone_bit(p, 1)) & zone_holds(F.col("bits"), zone_bit(p, 2))

        asked = F.lit(probes).cast("array<bigint>")
        marked = zones.select("file", F.exists(asked, here).alias("hit")).groupBy("file").agg(F.bool_or("hit").alias("hit"))
        hits = {r["file"]: r["hit"] for r in marked.collect()}  # one row a file
        return [f for f in files if hits.get(zone_name(f), True)]

    def point_rows(self, probes: list[int]) -> DataFrame:
        """Rows of a few indices, read from the files that may hold them."""
        files = self.files_of(probes) if probes else []
        if not files:
            return self.spark.createDataFrame([], SCHEMA)
        read = self.spark.read.schema(STORED).option("basePath", self.path).parquet(*files)
        return read.where(F.col("index").isin(probes)).select("index", "ordinal", "pos", "tokens")

    def overlaps(self) -> DataFrame:
        """Stored rows that meet an earlier row of their index (appends may cause this)."""
        rows = self.rows().where(F.size("tokens") > 0)
        reach = F.struct("index", (F.col("pos") + F.size("tokens") - 1).alias("hi"))
        keyed = rows.select("index", "ordinal", "pos", reach.alias("reach"))
        scanned = ordered_scan(keyed, ["index", "pos", "reach", "ordinal"], max_before={"_reach": F.col("reach")})
        met = (F.col("_reach.index") == F.col("index")) & (F.col("_reach.hi") >= F.col("pos"))
        return scanned.where(met).select("index", "ordinal", "pos")


@dataclass
class OffsetArrays:
    """Five tables keyed by ordinals; the two offset tables end with a terminator row."""

    keys: DataFrame  # k_ord, key
    tuple_offsets: DataFrame  # k_ord, off
    positions: DataFrame  # t_ord, pos
    token_offsets: DataFrame  # t_ord, off
    tokens: DataFrame  # tok_ord, token

    NAMES = ("keys", "tuple_offsets", "positions", "token_offsets", "tokens")

    def write(self, path: str) -> None:
        for name in self.NAMES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> OffsetArrays:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in cls.NAMES])


def to_offset_arrays(index_map: DataFrame) -> OffsetArrays:
    """Offset arrays of flat map rows; one ordered scan gives every offset.

    Each index has exactly one row with ordinal 0, so counting those rows numbers
    the keys.
    """
    heads = F.when(F.col("ordinal") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    scanned = ordered_scan(
        index_map.select("index", "ordinal", "pos", "tokens"),
        ["index", "ordinal"],
        ordinal="t_ord",
        sum_before={"k_ord": heads, "tok_start": F.size("tokens").cast("bigint")},
    )
    scanned = materialize(scanned, "offsets")  # read by all five tables
    if scanned.isEmpty():
        raise ValueError("no data in the index map")
    first = scanned.where("ordinal = 0")
    ends = scanned.agg(
        F.count_if(F.col("ordinal") == 0).alias("n_keys"),
        F.count(F.lit(1)).alias("n_tuples"),
        F.max(F.col("tok_start") + F.size("tokens")).alias("n_tokens"),
    )
    tuple_offsets = first.select("k_ord", F.col("t_ord").alias("off")).unionByName(
        ends.select(F.col("n_keys").alias("k_ord"), F.col("n_tuples").alias("off"))
    )
    token_offsets = scanned.select("t_ord", F.col("tok_start").alias("off")).unionByName(
        ends.select(F.col("n_tuples").alias("t_ord"), F.col("n_tokens").alias("off"))
    )
    tokens = scanned.select("tok_start", F.posexplode("tokens").alias("_at", "token")).select(
        (F.col("tok_start") + F.col("_at")).alias("tok_ord"), "token"
    )
    return OffsetArrays(
        first.select("k_ord", F.col("index").alias("key")),
        tuple_offsets,
        scanned.select("t_ord", "pos"),
        token_offsets,
        tokens,
    )


def _bounds(offsets: DataFrame, key: str) -> DataFrame:
    """Half-open ranges from consecutive offsets, by an equi-join on the next ordinal."""
    nxt = offsets.select((F.col(key) - 1).alias(key), F.col("off").alias("end_excl"))
    return offsets.withColumnRenamed("off", "start").join(nxt, key)


def _members(ranges: DataFrame, key: str, member: str) -> DataFrame:
    """One row per ordinal of each range; long ranges are cut into blocks and spread first."""
    block = F.lit(OFFSET_BLOCK).cast("bigint")
    filled = ranges.where("end_excl > start")
    blocks = filled.withColumn(
        "_b", F.explode(F.sequence(int_div(F.col("start"), block), int_div(F.col("end_excl") - 1, block)))
    ).repartition("_b")
    low = F.greatest("start", F.col("_b") * block)
    high = F.least(F.col("end_excl"), (F.col("_b") + 1) * block) - 1
    return blocks.select(key, "start", F.explode(F.sequence(low, high)).alias(member))


def _token_lists(arrays: OffsetArrays) -> DataFrame:
    """``(t_ord, tokens)`` of tuples with tokens: tokens move as blocks, from which every tuple cuts its pieces."""
    block = F.lit(TOKEN_BLOCK).cast("bigint")
    cells = F.array_sort(F.collect_list(F.struct("tok_ord", "token"))).alias("_cells")
    blocks = arrays.tokens.groupBy(int_div(F.col("tok_ord"), block).alias("_b")).agg(cells)
    blocks = blocks.select("_b", F.transform("_cells", lambda c: c["token"]).alias("_block"))
    ranges = _bounds(arrays.token_offsets, "t_ord").where("end_excl > start")
    cut = ranges.withColumn(
        "_b", F.explode(F.sequence(int_div(F.col("start"), block), int_div(F.col("end_excl") - 1, block)))
    )
    low, high = F.greatest("start", F.col("_b") * block), F.least("end_excl", (F.col("_b") + 1) * block)
    part = F.slice("_block", (low - F.col("_b") * block + 1).cast("int"), (high - low).cast("int"))
    pieces = cut.join(blocks, "_b").select("t_ord", F.struct(low.alias("at"), part.alias("part")).alias("piece"))
    grouped = pieces.groupBy("t_ord").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return grouped.select("t_ord", F.flatten(F.transform("pieces", lambda p: p["part"])).alias("tokens"))


def from_offset_arrays(arrays: OffsetArrays) -> DataFrame:
    """Flat map rows of an offset-array form."""
    owned = _members(_bounds(arrays.tuple_offsets, "k_ord"), "k_ord", "t_ord")
    owned = owned.select("k_ord", "t_ord", (F.col("t_ord") - F.col("start")).alias("ordinal"))
    keyed = spread_join(owned, arrays.keys, ["k_ord"], ["t_ord"])
    lists = _token_lists(arrays)
    rows = keyed.join(arrays.positions, "t_ord").join(lists, "t_ord", "left")
    empty = F.array().cast("array<int>")
    return rows.select(
        F.col("key").alias("index"), "ordinal", "pos", F.coalesce("tokens", empty).alias("tokens")
    )
