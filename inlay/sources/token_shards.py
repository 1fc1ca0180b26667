"""Binary token shards: files of fixed-width little-endian integers, ``chunk`` per instance.

``TokenShards`` is a data source of that format.  It reads byte ranges of whole instances, all or the ones
asked for, and writes a shard as a stream, one Arrow batch at a time.

What to read is an option of the load and not a pushed filter: Spark 4.1 keeps the ranges chosen by the
filters of one plan for later plans of the same frame, which then lack rows.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds

from inlay.functions.tokens import int_div
from inlay.operators.scan import ordered_scan

SPLIT_BYTES = 64 << 20
OPEN_BYTES = 1 << 20  # what opening one more file counts for when small reads share a task
BATCH_BYTES = 4 << 20  # of a file, held by a reader at a time
SCHEMA = "shard_id bigint, local_index bigint, instance_id bigint, tokens array<bigint>"
WRITTEN = "shards.jsonl"


def _open(path: str):
    """File system and path of a shard, for local and remote storage."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the shards of a folder, by name."""
    from pyarrow import fs

    system, base = _open(path)
    found = system.get_file_info(fs.FileSelector(base))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".bin"))


def closed_ranges(wanted: Iterable[int | tuple[int, int]]) -> list[list[int]]:
    """Numbers and closed ranges as disjoint closed ranges in order."""
    out: list[list[int]] = []
    for low, high in sorted((w, w) if isinstance(w, int) else tuple(w) for w in wanted):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        elif low <= high:
            out.append([low, high])
    return out


def within(ranges: list[list[int]] | None, first: int, last_excl: int) -> list[tuple[int, int]]:
    """The parts of ``[first, last_excl)`` that lie in the ranges (in all of it, if there are none given)."""
    if ranges is None:
        return [(first, last_excl)] if first < last_excl else []
    out = []
    for low, high in ranges[bisect_left(ranges, first, key=lambda r: r[1]) :]:
        if low >= last_excl:
            break
        out.append((max(low, first), min(high + 1, last_excl)))
    return out


@dataclass
class Piece:
    """Consecutive instances ``[start, stop)`` of one shard."""

    path: str
    shard: int
    first: int
    start: int
    stop: int


@dataclass
class Pieces(ds.InputPartition):
    pieces: list[Piece] = field(default_factory=list)


class ShardReader(ds.DataSourceReader):
    """Instances in byte ranges; shards and instances that are not asked for are not opened."""

    def __init__(self, options):
        self.path = options["path"]
        self.chunk = int(options["chunk"])
        self.dtype = np.dtype(options.get("dtype", "uint32")).newbyteorder("<")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.width = self.chunk * self.dtype.itemsize
        self.shards, self.instances = (
            json.loads(options[name]) if name in options else None for name in ("shards", "instances")
        )

    def runs(self, shard: int, first: int, n: int) -> Iterator[tuple[int, int]]:
        """Wanted runs of local indices of one shard, none longer than a split."""
        step = max(1, self.split // self.width)
        if within(self.shards, shard, shard + 1):
            for low, high in within(self.instances, first, first + n):
                for at in range(low - first, high - first, step):
                    yield at, min(at + step, high - first)

    def partitions(self) -> list[Pieces]:
        out, held, first = [], self.split, 0
        for shard, (path, size) in enumerate(_files(self.path)):
            n = size // self.width
            for start, stop in self.runs(shard, first, n):
                cost = (stop - start) * self.width + OPEN_BYTES
                if held + cost > self.split:
                    out.append(Pieces())
                    held = 0
                out[-1].pieces.append(Piece(path, shard, first, start, stop))
                held += cost
            first += n
        return out

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a task gets when there are no partitions
            return
        system, _ = _open(self.path)
        rows = max(1, BATCH_BYTES // self.width)
        for piece in partition.pieces:
            with system.open_input_file(piece.path) as handle:
                for start in range(piece.start, piece.stop, rows):
                    local = np.arange(start, min(start + rows, piece.stop))
                    raw = handle.read_at(len(local) * self.width, start * self.width)
                    if len(raw) != len(local) * self.width:
                        raise ValueError(f"{piece.path} has become shorter")
                    tokens = np.frombuffer(raw, dtype=self.dtype).astype("int64")
                    ends = np.arange(0, len(tokens) + 1, self.chunk, dtype="int32")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(local), piece.shard, dtype="int64")),
                            pa.array(local),
                            pa.array(local + piece.first),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens)),
                        ],
                        names=["shard_id", "local_index", "instance_id", "tokens"],
                    )


@dataclass
class Written(ds.WriterCommitMessage):
    """Shards of one task: number, instances, name of the file so far."""

    shards: list[tuple[int, int, str]] = field(default_factory=list)


class ShardWriter(ds.DataSourceArrowWriter):
    """Shards as streams: a task holds one Arrow batch, whatever the size of a shard.

    Rows ``(index, tokens)`` come in order, each shard wholly in one task and without gaps.  A file
    gets its name when all tasks have ended, so attempts that fail or run twice leave no shard.
    """

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.per_shard = int(options["perShard"])
        self.dtype = np.dtype(options.get("dtype", "uint32")).newbyteorder("<")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]

    @property
    def staged(self) -> str:
        return f"{_open(self.path)[1]}/.staged-{self.job}"

    def _numbers(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the rows in the flat tokens, and the flat tokens in the type of the file."""
        flat = tokens.flatten()
        if tokens.null_count or flat.null_count:
            raise ValueError("a sequence or a token is null")
        values = flat.to_numpy(zero_copy_only=False)
        limits = np.iinfo(self.dtype)
        if len(values) and (values.min() < limits.min or values.max() > limits.max):
            raise ValueError(f"a token does not fit into {self.dtype.name}")
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(sizes)]), values.astype(self.dtype)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = _open(self.path)
        system.create_dir(self.staged, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done, out, expected = Written(), None, None
        try:
            for batch in iterator:
                index = batch.column("index").to_numpy(zero_copy_only=False)
                ends, values = self._numbers(batch.column("tokens"))
                shards = index // self.per_shard
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(index)]
                for low, high in zip(cuts, cuts[1:]):
                    if low == high:
                        continue
                    shard = int(shards[low])
                    if not done.shards or done.shards[-1][0] != shard:
                        if out is not None:
                            out.close()
                        name = f"{self.staged}/{shard:08d}-{attempt}.bin"
                        out, expected = system.open_output_stream(name), shard * self.per_shard
                        done.shards.append((shard, 0, name))
                    if not np.array_equal(index[low:high], np.arange(expected, expected + high - low)):
                        raise ValueError(f"shard {shard} has a gap or a repeated instance behind {expected - 1}")
                    out.write(values[ends[low] : ends[high]].tobytes())
                    expected += int(high - low)
                    done.shards[-1] = (shard, expected - shard * self.per_shard, name)
        finally:
            if out is not None:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = _open(self.path)
        shards = sorted(s for m in messages if m is not None for s in m.shards)
        for (shard, held, _), (after, *_rest) in zip(shards, shards[1:]):
            if shard == after:
                raise ValueError(f"shard {shard} was written by two tasks")
            if held < self.per_shard:
                raise ValueError(f"shard {shard} has {held} instances and is not the last one")
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for path, _ in _files(self.path):
                system.delete_file(path)
        for shard, _, name in shards:
            system.move(name, f"{base}/{shard:08d}.bin")
        lines = [json.dumps({"shard": shard, "instances": held}) + "\n" for shard, held, _ in shards]
        with system.open_output_stream(f"{base}/{WRITTEN}") as out:
            out.write("".join(lines).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _ = _open(self.path)
        if system.get_file_info(self.staged).type == fs.FileType.Directory:
            system.delete_dir(self.staged)


class TokenShards(ds.DataSource):
    """``spark.read.format("token_shards")`` with ``chunk`` (tokens an instance), ``dtype``, ``splitBytes``
    and, as JSON lists of closed ranges, ``shards`` and ``instances``.

    ``df.write.format("token_shards")`` takes ``perShard`` and ``dtype``; :func:`write_shards` brings rows into order.
    """

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, overwrite)


def list_shards(spark: SparkSession, path: str, chunk: int, dtype: str = "uint32") -> DataFrame:
    """``(shard_id, path, first, last_excl, trailing)`` by file name; reads names and sizes only.

    ``trailing`` counts the bytes behind the last whole instance, which no instance is made of.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length")
    sized = files.withColumn("n", int_div(F.col("length"), width * chunk))
    ranked = ordered_scan(sized, ["path"], ordinal="shard_id", sum_before={"first": F.col("n")})
    trailing = F.col("length") % (width * chunk)
    return ranked.select(
        "shard_id", "path", "first", (F.col("first") + F.col("n")).alias("last_excl"), trailing.alias("trailing")
    )


def read_shards(
    spark: SparkSession,
    path: str,
    chunk: int,
    dtype: str = "uint32",
    shards: Iterable[int | tuple[int, int]] | None = None,
    instances: Iterable[int | tuple[int, int]] | None = None,
) -> DataFrame:
    """All instances as ``(shard_id, local_index, instance_id, tokens)``, or those asked for.

    ``shards`` and ``instances`` hold numbers and closed ranges; only their bytes are read, and small
    reads share tasks.  Numbers behind the end name nothing.  Shards are cut into byte ranges of whole instances,
    so a file of any size is read by many tasks.  The list of files and ranges lies in the driver.
    """
    spark.dataSource.register(TokenShards)
    source = spark.read.format("token_shards").option("chunk", chunk).option("dtype", dtype)
    for name, wanted in (("shards", shards), ("instances", instances)):
        if wanted is not None:
            source = source.option(name, json.dumps(closed_ranges(wanted)))
    return source.option("splitBytes", SPLIT_BYTES).load(path)


def write_shards(
    sequences: DataFrame, path: str, per_shard: int, dtype: str = "uint32", mode: str = "append"
) -> DataFrame:
    """Write ``sequences(index, tokens)`` as shards of ``per_shard`` instances; returns one row per file.

    Indices of a shard have no gaps, and only the last shard may be short; anything else is an
    error, for a place in a file is all that tells an instance.  A shard that exists is replaced as a whole;
    ``overwrite`` removes the others first.
    """
    spark = sequences.sparkSession
    spark.dataSource.register(TokenShards)
    dealt = sequences.select("index", "tokens").repartition(int_div(F.col("index"), per_shard))
    writer = dealt.sortWithinPartitions("index").write.format("token_shards").mode(mode)
    writer.option("perShard", per_shard).option("dtype", dtype).save(path)
    return spark.read.schema("shard bigint, instances bigint").json(f"{path}/{WRITTEN}")
