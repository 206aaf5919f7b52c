"""New hashes joined with stored ones, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from dittograph.operators.similar import MAX_DISTANCE, hamming_cross, hamming_pairs, similar_components
from dittograph.functions.paths import file_name, is_image
from dittograph.plans.similar_images import plain
from dittograph.sources.images import hashed, read_images

HASHES = "id long, hash long"
EDGES = "i long, j long, hd long"


def file_stream(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Files as they arrive below a folder, at most ``max_files`` in a batch: (path, name, size, modified)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root)
    return rows.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def hash_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes (id, hash) as Parquet files arrive in a folder."""
    return spark.readStream.schema(StructType.fromDDL(HASHES)).parquet(folder)


def grow_edges(batch: DataFrame, hashes_dir: str, edges_dir: str, batch_id: int, most: int = MAX_DISTANCE) -> None:
    """Append the edges of a batch, with each other and with hashes stored before, then the hashes.

    Each batch writes its own partition anew, so a batch that is run again adds nothing twice.
    """
    spark = batch.sparkSession
    stored = spark.read.schema(HASHES + ", batch int").parquet(hashes_dir).filter(F.col("batch") < batch_id).select("id", "hash")
    new = batch.filter("hash is not null").select("id", "hash").dropDuplicates(["id"]).join(stored.select("id"), "id", "left_anti")
    inner = hamming_pairs(new, most)
    cross = hamming_cross(stored, new, most)
    inner.unionByName(cross).write.mode("overwrite").parquet(f"{edges_dir}/batch={batch_id}")
    new.write.mode("overwrite").parquet(f"{hashes_dir}/batch={batch_id}")


def _prepared(spark: SparkSession, hashes_dir: str, edges_dir: str) -> None:
    """The tables have to exist before the first batch reads them."""
    spark.createDataFrame([], HASHES).write.mode("append").parquet(f"{hashes_dir}/batch=-1")
    spark.createDataFrame([], EDGES).write.mode("append").parquet(f"{edges_dir}/batch=-1")


def start(stream: DataFrame, hashes_dir: str, edges_dir: str, checkpoint: str, most: int = MAX_DISTANCE) -> StreamingQuery:
    """Keep edges up to date with a stream of hashes; what has arrived is worked off, then it stops."""
    spark = stream.sparkSession
    _prepared(spark, hashes_dir, edges_dir)
    write = stream.writeStream.foreachBatch(lambda batch, k: grow_edges(batch, hashes_dir, edges_dir, k, most))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_images(spark: SparkSession, root: str, hashes_dir: str, edges_dir: str, checkpoint: str, most: int = MAX_DISTANCE, max_files: int = 1000) -> StreamingQuery:
    """From image files as they arrive to edges between them: each batch is decoded, hashed and joined with all before.

    The paths of a batch, ``max_files`` at most, pass the driver, since only the batch source decodes. An image's id is
    ``image_id`` of its path; the paths go to a table beside the edges.
    """
    _prepared(spark, hashes_dir, edges_dir)

    def work(batch: DataFrame, k: int) -> None:
        new = [r.path for r in batch.filter(is_image(F.col("name"))).select("path").distinct().collect()]
        if new:
            found = hashed(read_images(spark, new)).select(image_id(F.col("path")).alias("id"), plain(F.col("path")).alias("path"), "hash")
            grow_edges(found.select("id", "hash"), hashes_dir, edges_dir, k, most)
            found.select("id", "path").write.mode("overwrite").parquet(f"{edges_dir}-names/batch={k}")

    return file_stream(spark, root, max_files).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def image_id(path: Column) -> Column:
    return F.xxhash64(plain(path))


def image_groups(spark: SparkSession, edges_dir: str) -> DataFrame:
    """Groups of all images so far: (path, component)."""
    names = spark.read.schema("id long, path string, batch int").parquet(f"{edges_dir}-names").select("id", "path").distinct()
    return groups(spark, edges_dir).join(names, "id").select("path", "component")


def groups(spark: SparkSession, edges_dir: str) -> DataFrame:
    """Groups of all edges so far: (id, component)."""
    return similar_components(spark.read.schema(EDGES + ", batch int").parquet(edges_dir).select("i", "j"))
