"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

import quire
from quire.session import ensure_checkpoint_dir

GOLD = np.uint64(0x9E3779B97F4A7C15)
MULT = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quire-llm/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: tasks
    import the operators' helpers, wherever the driver found them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(quire.__file__).parent
        path = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*")):
                if f.is_file() and "__pycache__" not in f.parts:
                    z.write(f, f"quire/{f.relative_to(root)}")
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: cuts the
    lineage, survives a lost executor, and gives later joins a plain scan
    (so adaptive execution can split skewed partitions)."""
    ship(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    """schema and the fields of ddl behind it."""
    return StructType([*schema.fields, *_parse_datatype_string(ddl).fields])


def arrow_map(df: DataFrame, fn: Callable, schema: str | StructType, slice_rows: int = 2048,
              start: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over slices of at most ``slice_rows`` rows.

    ``fn(batch, state)`` returns the output columns in schema order (or
    None for no rows); ``start()`` makes the per-task state."""
    ship(df.sparkSession)
    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for whole in batches:
            for at in range(0, whole.num_rows, slice_rows):
                cols = fn(whole.slice(at, slice_rows), state)
                if cols is not None and len(cols[0]):
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
                         for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, schema)


def text_key(col="text"):
    """Tells rows of one doc_id apart by their text; rows equal in both are
    one document."""
    return F.xxhash64(col)


def document_key(docs: DataFrame):
    """``text_key`` where an id is repeated; else 0, which takes no room in a
    shuffle, as ids alone tell documents apart."""
    once = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    return F.lit(0).cast("long") if once else text_key()


def held_out(col="doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    x = (x ^ (x >> np.uint64(32))) * MULT
    x = (x ^ (x >> np.uint64(29))) * GOLD
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; fewer words: the whole sequence as one."""
    if len(h) == 0:
        return h
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = mix(out * GOLD + h[i:len(h) - n + 1 + i])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
