"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def body(text: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """The fold that no model is fitted on: crc32 of the id as text leaves 2 when divided by 4; null ids are in it never."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Seconds between two times that a worker gives memory back.
GIVE_BACK_S = 1.0
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(mapper: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A mapper of Arrow batches whose worker gives freed memory back to the system, now and then and at its end.

    Workers live on between tasks and stages, beside the JVM: what their allocators keep counts against their executor.
    """

    @functools.wraps(mapper)
    def run(*args, **how) -> Iterator[pa.RecordBatch]:
        given = time.monotonic()
        for batch in mapper(*args, **how):
            yield batch
            if time.monotonic() - given > GIVE_BACK_S:
                give_back()
                given = time.monotonic()
        give_back()

    return run


#: Ranges of ids that `following` cuts a table into, at most.
MOST_RANGES = 1024


def following(df: DataFrame, id_col: str, carry: list[str], ranges: int | None = None) -> DataFrame:
    """`df` with next_<c> for each c of `carry`: its value in the next row by ascending id, after the last in the first.

    One shuffle by ranges of ids, whose bounds are sampled quantiles; the rows with the lowest id of a range go to the
    range before it as well, where they only end the window. Null ids come first; equal ids are ordered by `carry`.
    """
    spark = df.sparkSession
    ranges = ranges or min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.col(id_col)
    bounds = df.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b")).first()["b"]
    cuts = F.array(*(F.lit(b) for b in sorted(set(bounds or [])))).cast("array<bigint>")
    part = F.when(own.isNull(), 0).otherwise(F.size(F.filter(cuts, lambda b: b < own)) + 1)
    lowest = df.groupBy(part.alias("part")).agg(F.min(id_col).alias("low")).orderBy("part").collect()  # a row for each range
    before = {low: lowest[k - 1]["part"] for k, (_, low) in enumerate(lowest)}  # before the first comes the last
    known = F.create_map(*(F.lit(x) for low, to in before.items() if low is not None for x in (low, to))).cast("map<bigint,int>")
    also = F.when(own.isNull(), F.lit(before.get(None)).cast("int")).otherwise(known[own.cast("long")])
    n = {x: fresh(df, x) for x in ("part", "copy")}
    rows = df.withColumn(n["part"], F.explode(F.filter(F.array(F.struct(part.alias("p"), F.lit(0).alias("copy")), F.struct(also.alias("p"), F.lit(1).alias("copy"))), lambda x: x["p"].isNotNull())))
    rows = rows.withColumns({n["copy"]: F.col(n["part"])["copy"], n["part"]: F.col(n["part"])["p"]})
    order = W.partitionBy(n["part"]).orderBy(n["copy"], own.asc_nulls_first(), *carry)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry})
    return rows.filter(F.col(n["copy"]) == 0).drop(n["part"], n["copy"])
