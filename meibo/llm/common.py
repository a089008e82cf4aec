"""Small column helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order, unchanged."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    A plain column expression that is named inside a lambda would be computed again for every
    element, since the optimizer merges neighbouring projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one if a column is called so; names that differ by case only are the same to Spark."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns: list[str], names: tuple[str, ...]) -> list[str]:
    """The columns whose names are not among ``names``, whatever their case."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def row_values(columns: list[str]) -> list[Column]:
    """What to hash so that rows that differ have different hashes: the columns, and which of them are null, since hashes skip nulls."""
    named = [F.col(f"`{c}`") for c in columns]
    return [*named, F.concat_ws("", F.lit("nulls"), *[F.when(c.isNull(), "1").otherwise("0") for c in named])]


def shared_dir(spark: SparkSession) -> None:
    """Makes sure that ``checkpoint()`` has a folder that all executors share: the one in ``spark.checkpoint.dir``."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # in one process, as in tests, any folder is shared
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that nothing before it is computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function for ``mapInArrow``, giving its memory back at its end, since Spark uses a worker for many tasks."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied
