"""Exact duplicates: by name and size, or by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dittograph.functions.fingerprints import quick_hash, sha256_hex

KEY = ("size", "name")


def visible(files: DataFrame) -> DataFrame:
    """Without hidden and system files and links; a null flag counts as false."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("is_hidden", "is_system", "is_reparse") if c in files.columns]
    for f in flags:
        files = files.filter(~f)
    return files


def size_between(files: DataFrame, min_mb: int = 0, max_mb: int = 0) -> DataFrame:
    """Files within bounds in megabytes of 1024 * 1024 bytes, both included; 0 is no bound."""
    if min_mb < 0 or max_mb < 0 or 0 < max_mb < min_mb:
        raise ValueError("bounds must not be negative, nor the lower above the upper")
    if min_mb:
        files = files.filter(F.col("size") >= min_mb << 20)
    if max_mb:
        files = files.filter(F.col("size") <= max_mb << 20)
    return files


def group_key() -> Column:
    return F.concat(F.col("name"), F.lit("_"), F.col("size").cast("string"))


def name_size_groups(files: DataFrame) -> DataFrame:
    """A row for each (size, name) that several files have: key, count, wasted bytes, least path.

    One aggregation with partial sums before its shuffle; no list of files is gathered.
    """
    groups = files.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("representative"))
    return groups.filter("n_files > 1").select(
        group_key().alias("group_key"), "name", "size", "n_files", ((F.col("n_files") - 1) * F.col("size")).alias("wasted"), "representative"
    )


def members(files: DataFrame) -> DataFrame:
    """Every file of a duplicate group, with the group's count and wasted bytes and its rank by path."""
    same = Window.partitionBy(*KEY)
    rows = files.withColumn("n_files", F.count(F.lit(1)).over(same)).filter("n_files > 1")
    return rows.select(
        "path", "name", "size", "n_files", ((F.col("n_files") - 1) * F.col("size")).alias("wasted"), F.row_number().over(same.orderBy("path")).alias("rank_in_group")
    )


def group_limits(groups: DataFrame, limit: int) -> DataFrame:
    """How many files of each group an output of ``limit`` files takes, groups in order of size and name.

    Groups without any are left out; 0 is no limit. The running sum is taken
    over at most ``limit`` groups, since each has two files at least, so the one
    unpartitioned window sees a top-k and not the table.
    """
    if limit <= 0:
        return groups.withColumn("taken", F.col("n_files"))
    first = groups.orderBy("size", "name").limit(limit)
    before = F.coalesce(F.sum("n_files").over(Window.orderBy("size", "name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("taken", F.least(F.col("n_files"), F.lit(limit) - before)).filter("taken > 0")


def limited_members(files: DataFrame, limit: int) -> DataFrame:
    """Files of duplicate groups up to a limit in all; the last group may be cut, to one file even."""
    taken = group_limits(name_size_groups(files), limit).select("size", "name", "taken")
    return members(files).join(taken, ["size", "name"]).filter(F.col("rank_in_group") <= F.col("taken")).drop("taken")


def totals(files: DataFrame) -> DataFrame:
    """One row: files, distinct keys, duplicate groups, files in them, wasted bytes."""
    keys = files.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files_scanned"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(many).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(many, (F.col("n") - 1) * F.col("size"))), F.lit(0)).alias("wasted"),
    )


def content_groups(files: DataFrame, quick: bool = False) -> DataFrame:
    """Groups of files with equal content (column ``content``): digest, size, count, least path."""
    digest = quick_hash(F.col("content")) if quick else sha256_hex(F.col("content"))
    rows = files.filter("content is not null").select(digest.alias("digest"), "size", "path")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_files"), F.min("size").alias("size"), F.min("path").alias("representative")).filter("n_files > 1")


def size_then_content(files: DataFrame) -> DataFrame:
    """As :func:`content_groups`, but only contents of a size that several files have are hashed.

    Sizes are counted from metadata alone; with a file source the content of other files isn't read.
    """
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size")
    return content_groups(files.join(sizes, "size", "left_semi"))
