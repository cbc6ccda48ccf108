"""Warehouse tables as Parquet folders with committed snapshots.

Rows lie in ``<root>/<table>/slice=<s>/version=<n>``. A slice is a range of the key, so a key
never changes slice and an upsert reads and rewrites only the slices its batch touches. A small
file per version lists the live version of every slice and is put in place by a rename once the
data are written. Readers take the newest list: they never see a half-written version, and a
killed job leaves the previous snapshot in force.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens import schemas
from ticketlens.operators.upsert import latest_per_key, merge_snapshot, replace_by
from ticketlens.session import cut_lineage

_WHOLE = 0  # the only slice of a table that is not split
_NO_KEY = -1  # of rows whose key is NULL


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, rows_per_slice: int = 1_000_000):
        self.spark = spark
        self.root = root.rstrip("/")
        self.rows_per_slice = rows_per_slice

    def _data(self, table: str) -> str:
        return f"{self.root}/{table}/data"

    def _commits(self, table: str) -> str:
        return f"{self.root}/{table}/commits"

    def _at(self, name: str):
        """The Hadoop path of ``name`` and its file system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        """Names below ``folder``; none when it does not exist."""
        path, fs = self._at(folder)
        return [e.getPath().getName() for e in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self, table: str) -> list[int]:
        """Committed versions, ascending."""
        names = self._list(self._commits(table))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _live(self, table: str, below: int | None) -> dict[int, int]:
        """Live version per slice: as many entries as the table has slices."""
        known = [v for v in self.versions(table) if below is None or v < below]
        if not known:
            return {}
        path, fs = self._at(f"{self._commits(table)}/{known[-1]:09d}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(s): v for s, v in json.loads(text).items()}

    def _open(self, table: str, live: dict[int, int]) -> DataFrame:
        layout = schemas.WAREHOUSE[table].layout
        if not live:
            return self.spark.createDataFrame([], layout)
        folders = [f"{self._data(table)}/slice={s}/version={v}" for s, v in sorted(live.items())]
        return self.spark.read.schema(layout).parquet(*folders)

    def read(self, table: str, below: int | None = None) -> DataFrame:
        """Latest snapshot (older than ``below`` if given); an empty frame before the first."""
        return self._open(table, self._live(table, below))

    def ensure_schema(self) -> list[str]:
        """Create the tables that do not exist yet; returns their names."""
        missing = [name for name in schemas.WAREHOUSE if not self.versions(name)]
        for name in missing:
            self._commit(name, 1, {})
        return missing

    def _slice(self, table: str) -> Column:
        key = schemas.WAREHOUSE[table].sliced_by
        if key is None:
            return F.lit(_WHOLE).cast("bigint")
        # whole-number division is exact for every key; rows without a key have a slice too
        return F.coalesce(F.expr(f"`{key}` div {self.rows_per_slice}"), F.lit(_NO_KEY).cast("bigint"))

    def _commit(self, table: str, version: int, live: dict[int, int]) -> None:
        """Write the list under a passing name and rename it, which makes it count at once."""
        passing, fs = self._at(f"{self._commits(table)}/.{version:09d}")
        final, _ = self._at(f"{self._commits(table)}/{version:09d}.json")
        stream = fs.create(passing, True)
        try:
            stream.write(bytearray(json.dumps(live, sort_keys=True), "utf-8"))
        finally:
            stream.close()
        fs.delete(final, False)
        if not fs.rename(passing, final):
            raise RuntimeError(f"could not commit version {version} of {table}")

    def _write(self, table: str, rows: DataFrame, version: int) -> None:
        """Write one folder per slice. A slice fits one task by design."""
        tagged = rows.withColumns({"slice": self._slice(table), "version": F.lit(version)})
        if schemas.WAREHOUSE[table].sliced_by is not None:
            tagged = tagged.repartition("slice")
        (
            tagged.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("slice", "version")
            .parquet(self._data(table))
        )

    def _written(self, table: str, slices, version: int) -> dict[int, int]:
        """Those of ``slices`` that received rows in ``version``."""
        return {
            s: version
            for s in slices
            if self._list(f"{self._data(table)}/slice={s}/version={version}")
        }

    def publish(self, table: str, rows: DataFrame, version: int | None = None) -> int:
        """Replace the whole table."""
        version = version if version is not None else max(self.versions(table), default=0) + 1
        self._write(table, self._conform(table, rows), version)
        names = [n for n in self._list(self._data(table)) if n.startswith("slice=")]
        slices = [int(n.removeprefix("slice=")) for n in names]
        self._commit(table, version, self._written(table, slices, version))
        return version

    def _conform(self, table: str, rows: DataFrame, *more: str) -> DataFrame:
        """Columns the layout and the batch share, in declared types, plus ``more``."""
        layout = schemas.WAREHOUSE[table].layout
        present = [f for f in layout.fields if f.name in rows.columns]
        extra = [F.col(c) for c in more if c not in layout.names]
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in present], *extra)

    def replace(
        self, table: str, rows: DataFrame, now: Column, column: str, values
    ) -> int:
        """Put ``rows`` in place of all rows whose ``column`` is one of ``values``."""
        spec = schemas.WAREHOUSE[table]
        fresh = self._conform(table, rows).withColumns(
            {c: now for c in (*spec.stamped, *spec.stamped_on_insert)}
        )
        return self.publish(table, replace_by(self.read(table), fresh, column, values))

    def upsert(
        self, table: str, batch: DataFrame, now: Column, order_by=(), version: int | None = None
    ) -> int:
        """Merge ``batch`` into the table by its key. Returns the new version.

        With an explicit ``version`` (a streaming batch number) a replay rewrites the same
        folders from the same older snapshot, so it changes nothing.
        """
        spec = schemas.WAREHOUSE[table]
        live = self._live(table, version)
        version = version if version is not None else max(self.versions(table), default=0) + 1
        fresh = latest_per_key(self._conform(table, batch, *order_by), spec.keys, order_by)
        touched = {_WHOLE}
        if spec.sliced_by is not None:
            fresh = cut_lineage(fresh)
            # a batch touches few slices, and never more than the table has
            slices = fresh.select(self._slice(table).alias("s")).distinct()
            touched = {r["s"] for r in slices.collect()}
        old = self._open(table, {s: v for s, v in live.items() if s in touched})
        merged = merge_snapshot(
            old, fresh, spec.keys, stamp=spec.stamped, stamp_on_insert=spec.stamped_on_insert,
            now=now, unique=True,
        )
        self._write(table, merged.select(*spec.layout.names), version)
        self._commit(table, version, live | self._written(table, touched, version))
        return version
