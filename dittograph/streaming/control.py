"""Counts while a plan runs, and cancelling it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation that has their number, and the counts given, once an action is over."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Actions inside carry a tag by which another thread can cancel them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[int]:
    """Cancel all jobs with a tag; returns the numbers of the jobs that run just then. The action that waits for one of them fails."""
    found = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag)
    running = set(spark.sparkContext.statusTracker().getActiveJobsIds()) & set(found)
    spark.sparkContext.cancelJobsWithTag(tag)
    return sorted(running)
