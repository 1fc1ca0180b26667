"""What a micro-batch stores, in one form or several, seen by readers together or not at all.

``<path>/<form>/write_id=<write>`` holds the rows of one form, by period: a write of few periods has a folder for
each, one of many (its name begins with ``wide``) has files sorted by period, so the number of files
follows the bytes and not the periods.  ``<path>/commits`` holds one empty
file per write that was finished, named by batch, attempt and write; creating it is the commit.  Of
several attempts at a batch the last one counts, so a batch that runs again replaces all it stored before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from inlay.staging import materialize

FIRST = "plan"
WIDE = "wide"  # begins the name of a write whose files are sorted by period
FOLDERS = 64  # periods up to which each has a folder of its own


@dataclass
class Snapshots:
    spark: SparkSession
    path: str

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        files, at = self._file(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _folder(self, form: str, write: str) -> str:
        return f"{self.path}/{form}/write_id={write}"

    def commits(self) -> list[tuple[int, int, str]]:
        """``(batch, attempt, write)`` of every finished write, in order."""
        parts = [n.split("-") for n in self._names(f"{self.path}/commits")]
        return [(int(batch), int(attempt), write) for batch, attempt, write in parts]

    def writes(self) -> list[str]:
        """The write that counts of each batch."""
        return list({batch: write for batch, _, write in self.commits()}.values())

    def save(
        self, batch_id: int, plan: DataFrame, schema: str, **derived: Callable[[DataFrame], DataFrame]
    ) -> None:
        """Store ``plan`` and the forms derived from it; all have a column ``period``.

        All forms are made from one staged copy of ``plan``, so they agree whatever happens
        to ``plan`` when it is computed again.
        """
        rows = materialize(plan.select(*[c.split()[0] for c in schema.split(", ")]), "batch")
        wide = rows.select("period").distinct().limit(FOLDERS + 1).count() > FOLDERS
        write = (WIDE if wide else "") + uuid.uuid4().hex
        self._write(rows, FIRST, write)
        for form, derive in derived.items():
            self._write(derive(rows), form, write)
        self._commit(batch_id, write)

    def _write(self, rows: DataFrame, form: str, write: str) -> None:
        """Rows of a period side by side; a large period may be cut."""
        if not write.startswith(WIDE):
            rows.hint("rebalance", "period").write.partitionBy("period").parquet(self._folder(form, write))
            return
        order = ["period", *[c for c, kind in rows.dtypes if c != "period" and not kind.startswith("array")]]
        rows = rows if form == FIRST else materialize(rows, form)  # read twice by the next step
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(self._folder(form, write))

    def _commit(self, batch_id: int, write: str) -> None:
        attempt = sum(batch == batch_id for batch, _, _ in self.commits())
        files, at = self._file(f"{self.path}/commits/{batch_id:012d}-{attempt:06d}-{write}")
        files.create(at, False).close()

    def read(self, schema: str, form: str = FIRST) -> DataFrame:
        """Rows of a form, of finished writes alone; a filter on ``period`` picks the folders, or parts of the sorted files, to read."""
        writes = self.writes()
        found = self.spark.createDataFrame([], schema)
        for wide in (False, True):
            folders = [self._folder(form, write) for write in writes if write.startswith(WIDE) == wide]
            if folders:
                rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{form}").parquet(*folders)
                found = found.unionByName(rows.drop("write_id"))
        return found

    def vacuum(self) -> list[str]:
        """Delete folders of unfinished and replaced writes.  No batch may be at work."""
        kept, gone = {f"write_id={write}" for write in self.writes()}, []
        for form in self._names(self.path):
            for write in self._names(f"{self.path}/{form}") if form != "commits" else []:
                if write not in kept:
                    files, at = self._file(f"{self.path}/{form}/{write}")
                    files.delete(at, True)
                    gone.append(f"{form}/{write}")
        return gone
