"""What the operators of this subpackage share: shared folders, whole texts as bytes, Arrow passes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flipside.session import checkpoint_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; all executors see it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MEMOS: list = []
_LAST: list[str] = [""]


def worker_memo(make: Callable) -> Callable:
    """What a Python worker keeps from task to task of one operator (vocabularies, segments seen)."""
    _MEMOS.append(lru_cache(maxsize=2)(make))
    return _MEMOS[-1]


def trim() -> None:
    """Freed memory goes back to the system, where the C library can do that (glibc); else it stays with the worker."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def turn(operator: str) -> None:
    """Called as a task begins: workers serve many stages, and what the one before has kept goes, so that memory
    holds the memos of one operator at a time."""
    if _LAST[0] != operator:
        _LAST[0] = operator
        for memo in _MEMOS:
            memo.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim()


def map_arrow(df: DataFrame, schema: str | StructType, prepare: Callable, *args) -> DataFrame:
    """``prepare(*args)`` runs once a task and returns a function from a record batch to a dict of
    columns (or an iterator of such dicts); ``schema`` gives their types."""
    spark_schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flipside.llm import common  # the worker's own module: this function is a copy with its own globals

        common.turn(f"{prepare.__module__}.{prepare.__qualname__}")
        step = prepare(*args)
        for batch in batches:
            for part in pieces(batch):
                gc.disable()  # it would walk a step's long lists of words again and again; they hold no cycles
                try:
                    out = step(part)
                finally:
                    gc.enable()
                for columns in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays(
                        [_column(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes, so that a task's working memory doesn't follow the row count."""
    n = batch.num_rows
    if n == 0:
        return
    rows = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of the texts of a batch; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def lowest(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of ``df``: those whose ids hash lowest. A count sets a threshold that leaves hardly more
    than ``n`` rows, so tasks don't each pass on their lowest ``n``."""
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)
    reach = (n + 6 * n**0.5 + 20) / max(1, df.count())
    few = df.where(key < int(reach * 2**63)) if reach < 1 else df
    return few.orderBy(key, id_col).limit(n)


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of
