"""Written intermediate tables and merged task counters, shared by the operators here."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgetide.staging import new_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch: a batch of texts must fit a Python worker several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: What a task holds of a file while it reads texts: a column of a row group may have hundreds of MB, which
#: vectored reads keep outside the heap, once for each task; rows are decoded a few at a time.
VECTORED = "parquet.hadoop.vectored.io.enabled"
READING = {VECTORED: "false", "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs run inside the block, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Tables one operator writes below the shared folder.

    ``stage`` runs a job once, writes its rows and lets go of its shuffle files, so a lost
    executor costs no earlier step; ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, f"llm-{label}")
        with settings(self.spark, {CLEANUP: "true"} | BATCH | READING):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *staged: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in staged:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
            path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.option(VECTORED, "false").parquet(f"{sf_dir}/{name}.parquet")


def text_key(column: str = "text") -> Column:
    """64-bit key of a text; a null text has a key of its own."""
    return F.when(F.col(column).isNull(), F.lit(-1).cast("bigint")).otherwise(F.xxhash64(column))


def packed_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key): each row whole as a struct, so that no column of it can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("key"))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def batches(rows: Iterator, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


CELLS = 1024
COUNTER = pa.schema([("block", pa.int32()), ("payload", pa.binary())])


def packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's counters as compressed blocks of ``CELLS`` cells, blocks of zeros left out."""
    for block, part in enumerate(counts.reshape(-1, CELLS)):
        if part.any():
            yield block, zlib.compress(part.tobytes(), 1)


def summed(parts: DataFrame, dtype: str) -> DataFrame:
    """Blocks of all tasks added up, block by block; a task holds its own blocks only."""
    def add(rows):
        total: dict[int, np.ndarray] = {}
        for batch in rows:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"]):
                part = np.frombuffer(zlib.decompress(payload.as_py()), dtype)
                if block in total:
                    total[block] += part
                else:
                    total[block] = part.astype(dtype)
        yield from batches(((b, zlib.compress(v.tobytes(), 1)) for b, v in total.items()), COUNTER)

    return (parts.select("block", "payload").repartition("block")
            .mapInArrow(add, "block int, payload binary"))


def gathered(parts: DataFrame, cells: int, dtype: str) -> np.ndarray:
    """The merged counters on the driver: ``cells`` numbers, whatever the input."""
    out = np.zeros((cells // CELLS, CELLS), dtype)
    for block, payload in summed(parts, dtype).collect():
        out[block] = np.frombuffer(zlib.decompress(payload), dtype)
    return out.reshape(-1)
