"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import _lru_cache_wrapper, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.shared import discard, materialize, shared_path  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

#: Rows that are Python objects at a time.
SLICE = 1000
#: Bytes of a join's side, 64 for each row besides its key's own length, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, key: str) -> DataFrame:
    """``df``, hinted to be broadcast where its rows, measured by ``key``, are few enough; else joined by a shuffle."""
    found = df.agg(F.sum(64 + F.octet_length(F.col(key).cast("string")))).first()[0] or 0
    return F.broadcast(df) if found <= BROADCAST_BYTES else df


#: What Python workers keep between tasks, by the operator that it serves.
_HELD: dict[str, list[_lru_cache_wrapper]] = {}


def held(operator: str, maxsize: int):
    """``lru_cache`` for what tasks of ``operator`` share in a worker; it goes when the worker runs a task of another operator."""

    def decorate(function):
        cached = lru_cache(maxsize)(function)
        _HELD.setdefault(operator, []).append(cached)
        return cached

    return decorate


def let_go(but: str) -> None:
    """Forget what is held for operators other than ``but``."""
    for operator, caches in _HELD.items():
        if operator != but:
            for cached in caches:
                cached.cache_clear()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, beside a heap that needs the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, holds: str = "") -> DataFrame:
    """``mapInArrow`` by tasks that use what is held for operator ``holds``, let go of the rest, and give back what they free."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def map_rows(
    df: DataFrame, per_batch: Callable[..., Iterable[list]], schema: str, names: list[str] | None = None, holds: str = ""
) -> DataFrame:
    """``map_arrow`` where ``per_batch`` gets each input column as a Python list and returns output columns."""
    spark = df.sparkSession
    out_schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    arrow_schema = to_arrow(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                columns = per_batch(*[c.to_pylist() for c in whole.slice(at, SLICE).columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema
                )

    return map_arrow(df, run, out_schema, holds)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
