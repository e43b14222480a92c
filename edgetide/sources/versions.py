"""Versions of a folder under numbered manifests: what is published is published at once.

Data is written into folders of its own; a manifest, one small JSON file per version, then names
the folders that belong to that version.  Manifests are written beside and renamed into place, which
fails if the number is taken: readers see a whole version or the one before it, and of two
writers the second is refused.  A writer that dies leaves folders no manifest names; the next one to
publish removes them, and all but the last ``KEEP`` versions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

KEEP = 2


class Taken(Exception):
    """Another writer has published this version."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.jvm, self.conf = jvm, conf
        self.files = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.files.listStatus(at)] if self.files.exists(at) else []

    def numbers(self) -> list[int]:
        """Published versions, in order."""
        return sorted(int(n[:-5]) for n in self._names("_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        stream = self.files.open(self._at(f"_manifests/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.manifest(numbers[-1])) if numbers else (-1, None)

    def folder(self, label: str = "data") -> str:
        """A fresh folder name below ``data``."""
        return f"data/{label}-{uuid.uuid4().hex}"

    def publish(self, number: int, manifest: dict) -> None:
        """Make ``manifest`` version ``number``; its ``folders`` are kept as long as it is."""
        beside = self._at(f"_manifests/.{number}-{uuid.uuid4().hex}")
        out = self.files.create(beside, True)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        fs = self.jvm.org.apache.hadoop.fs
        rename = getattr(fs, "Options$Rename")
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        context = fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        try:
            context.rename(beside, self._at(f"_manifests/{number}.json"), never)
        except Exception as error:
            self.files.delete(beside, False)
            raise Taken(f"version {number} of {self.path} is there already") from error
        self._prune()

    def _prune(self) -> None:
        numbers = self.numbers()
        kept = {f for n in numbers[-KEEP:] for f in self.manifest(n)["folders"]}
        for name in self._names("data"):
            if f"data/{name}" not in kept:
                self.files.delete(self._at(f"data/{name}"), True)
        for n in numbers[:-KEEP]:
            self.files.delete(self._at(f"_manifests/{n}.json"), False)
