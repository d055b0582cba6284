"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import threading
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources import shared
from lodestrata.sources.shared import filesystem, shared_dir, written

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "bucketed", "filesystem", "free_names", "held", "released", "removed", "resting", "shared_dir", "table", "words", "written"]

#: A word, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z lower-cased, and no other letter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text; null text has none."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def free_names(columns: Sequence[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column has, whatever its letters' case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What a worker keeps for its next task, by its name: one thing at a time, as the stages of a pipeline share their workers.
HELD: dict[Hashable, Any] = {}


#: Seconds without a task after which a worker keeps nothing: what runs in the JVM alone needs the memory.
REST = 0.5
RESTS: list[threading.Timer] = []


def held(name: Hashable, make: Callable[[], Any]) -> Any:
    """What this worker holds by a name, made if it holds something else or nothing; that goes before."""
    got = HELD.get(name)  # once: a rest may end between two looks
    if got is None:
        released()
        got = HELD[name] = make()
    return got


def released() -> None:
    """This worker keeps nothing, and its allocators give back what is free."""
    HELD.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def worked(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f(batches); if no other task follows within ``REST`` seconds, the worker keeps nothing."""
    while RESTS:
        RESTS.pop().cancel()
    try:
        yield from f(batches)
    finally:
        RESTS.append(threading.Timer(REST, released))
        RESTS[-1].daemon = True
        RESTS[-1].start()


def resting(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after whose last task workers soon keep nothing."""
    return lambda batches: worked(f, batches)


#: Bucketed tables of this driver, which are also names in the catalog.
TABLES: set[str] = set()


def removed(*frames: DataFrame) -> None:
    """Delete tables that ``written`` or ``bucketed`` made, once nothing reads them any more."""
    for df in frames:
        names = TABLES & {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        shared.removed(df)
        for name in names:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
            TABLES.discard(name)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df``, dealt by a column, as a table in the shared folder with one bucket a task: joins on the column leave it where it is."""
    spark = df.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"{name}_{uuid.uuid4().hex}"
    TABLES.add(name)
    df.write.bucketBy(tasks, column).option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)
