"""Keyed values as a compacted log of changes.

A batch writes only the keys it changed, as a *run*.  ``FAN`` runs of a level are merged, newest row per
key, into one run of the next level, so after n batches there are at most ``FAN - 1`` runs for each
of log(n) levels, and a row is rewritten once per level.  Which runs make up the table, and up to
which batch, is in a manifest that is swapped last (``sources.versions``): a batch that is run
again is either not there yet or skipped, and a crash between a merge and the manifest leaves the old
table.  One stream owns a log; another one, or the same one from a new checkpoint, is refused.

Null keys are keys.  ``keep`` drops rows that need not be remembered: readers never see them, and a
merge that takes in the oldest run removes them for good.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.sources.versions import Versions

FAN = 4
BATCH = "_batch"


class OtherStream(Exception):
    """The log belongs to another stream."""


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], stream: str | None = None,
                 keep: Column | None = None):
        self.spark, self.keys, self.stream, self.keep = spark, list(keys), stream, keep
        self.versions = Versions(spark, path)
        self.number, self.manifest = self.versions.newest()
        if self.manifest and stream is not None and self.manifest["stream"] != stream:
            raise OtherStream(f"{path} belongs to {self.manifest['stream']}")

    @property
    def facts(self) -> dict:
        """What the last batch noted beside its rows."""
        return self.manifest["facts"] if self.manifest else {}

    def has(self, batch: int) -> bool:
        return bool(self.manifest) and self.manifest["last"] >= batch

    def _read(self, runs: list[dict]) -> DataFrame:
        schema = self.manifest["schema"]
        return self.spark.read.schema(schema).parquet(*[f"{self.versions.path}/{r['folder']}" for r in runs])

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        return rows.groupBy(*self.keys).agg(
            *[F.max_by(c, BATCH).alias(c) for c in values], F.max(BATCH).alias(BATCH))

    def current(self) -> DataFrame | None:
        """The newest row per key; None before the first batch."""
        if not self.manifest:
            return None
        rows = self._newest(self._read(self.manifest["runs"])).drop(BATCH)
        return rows if self.keep is None else rows.filter(self.keep)

    def append(self, batch: int, rows: DataFrame, facts: dict | None = None) -> None:
        """Rows of the keys that ``batch`` changed, one each."""
        if self.has(batch):
            return
        named = rows.withColumn(BATCH, F.lit(batch).cast("long"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
        if self.manifest and self.manifest["schema"] != schema:
            raise ValueError(f"rows are {schema}, the log has {self.manifest['schema']}")
        runs = list(self.manifest["runs"]) if self.manifest else []
        self.manifest = {"stream": self.stream, "last": batch, "schema": schema, "facts": facts or {}}
        # a shuffle by key, merged to few files by their size
        runs.append(self._write(named.repartition(*self.keys) if self.keys else named.coalesce(1), 0))
        level = 0
        while sum(r["level"] == level for r in runs) >= FAN:
            own = [r for r in runs if r["level"] == level]
            runs = [r for r in runs if r["level"] != level]
            merged = self._newest(self._read(own)).select(*named.columns)
            if self.keep is not None and not runs:
                merged = merged.filter(self.keep)
            level += 1
            runs.append(self._write(merged, level))
        self.manifest |= {"runs": runs, "folders": [r["folder"] for r in runs]}
        self.number += 1
        self.versions.publish(self.number, self.manifest)

    def _write(self, rows: DataFrame, level: int) -> dict:
        folder = self.versions.folder(f"level{level}")
        rows.write.parquet(f"{self.versions.path}/{folder}")
        return {"folder": folder, "level": level}
