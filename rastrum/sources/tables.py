"""Rasters from tables and image files, and back."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.raster import Axis, Raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img8(spark: SparkSession, sf_dir: str) -> Raster:
    """Every embedding as an 8x8 image."""
    return Raster.from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (8, 8))


def img8q(spark: SparkSession, sf_dir: str) -> Raster:
    """The same, quantised to integers."""
    return Raster.from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (8, 8), value=F.round(F.col("v") * 1000).cast("long"))


def vol4(spark: SparkSession, sf_dir: str) -> Raster:
    return Raster.from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (4, 4, 4), names=("i", "j", "k2"))


def vol5(spark: SparkSession, sf_dir: str) -> Raster:
    return Raster.from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (2, 2, 2, 2, 4), names=("i", "j", "k2", "l", "m"))


def colours(spark: SparkSession, sf_dir: str) -> Raster:
    """Every embedding as an 8x4 image of two channels, the last axis."""
    return Raster.from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (8, 4, 2), names=("i", "j", "c"))


def signals(spark: SparkSession, sf_dir: str) -> Raster:
    """The values of each user's events in order of time: signals of different lengths."""
    return Raster.from_sequences(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


def hours(spark: SparkSession, sf_dir: str) -> Raster:
    """Event counts by day of the month and hour, one channel for each type of event."""
    events = table(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("i"), F.hour("ts").alias("j"))
    return Raster.from_counts(events, ("event_type",), (Axis("i", 1, 31), Axis("j", 0, 23)), F.count("*").cast("long"))


def shipments(spark: SparkSession, sf_dir: str) -> Raster:
    """Line items by ship month (0: January 1995) and quantity, from the least to the largest of each: one image without a key."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    lines = table(spark, sf_dir, "lineitem").select(month.cast("int").alias("i"), F.col("l_quantity").cast("int").alias("j")).dropna()
    ends = lines.agg(*[f(c).alias(f"{k}{c}") for c in ("i", "j") for k, f in (("low", F.min), ("high", F.max))]).first()
    axes = tuple(Axis(c, ends[f"low{c}"] or 0, ends[f"high{c}"] if ends[f"high{c}"] is not None else -1) for c in ("i", "j"))
    return Raster.from_counts(lines, (), axes, F.count("*").cast("long"))


def read_images(spark: SparkSession, path: str, height: int, width: int, channels: int, others: str = "error") -> Raster:
    """Image files of one size as rasters (keys: origin), with the channel as last axis ``c``; values 0..255. Files of another
    size, or that are no images, are an error, or left out with ``others="skip"``."""
    if others not in ("error", "skip"):
        raise ValueError(f"others: error or skip, not {others!r}")
    # Folders are listed by tasks, one for each folder up to 10,000 of them unless fewer are asked for: a task costs far more than a folder.
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(listing, None)
    spark.conf.set(listing, str(4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.format("image").option("dropInvalid", others == "skip").option("recursiveFileLookup", True).load(path).select("image.*")
    finally:
        spark.conf.unset(listing) if before is None else spark.conf.set(listing, before)
    fits = F.coalesce((F.col("height") == height) & (F.col("width") == width) & (F.col("nChannels") == channels), F.lit(False))
    size = F.format_string(f"%s is %s x %s x %s, not {height} x {width} x {channels}", "origin", "height", "width", "nChannels")
    images = files.where(fits) if others == "skip" else files.withColumn("data", F.when(fits, F.col("data")).otherwise(F.raise_error(size).cast("binary")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(b, np.uint8).astype(float) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.list_(pa.float64()))], names=["origin", "data"])

    rows = images.select("origin", "data").mapInArrow(run, "origin string, data array<double>")
    return Raster.from_array_column(rows, "origin", "data", (height, width, channels), names=("i", "j", "c"))


def write_bitmaps(df: DataFrame, key: str, column: str, shape: tuple[int, int], folder: str) -> None:
    """One uncompressed bitmap file of 24 bits for each row, grey: floor(100 v + 128) within 0..255, in a folder named by its key.

    Spark's text writer writes them, so that any store will do; the line end after a bitmap lies beyond the size in its header.
    """
    height, width = shape
    line = -(-3 * width // 4) * 4
    size = line * height
    header = b"BM" + struct.pack("<IHHI", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for values in batch.column(1).to_pylist():
                grey = np.clip(np.floor(np.array(values, float) * 100 + 128), 0, 255).astype(np.uint8).reshape(shape)[::-1]  # lowest line first
                lines = np.zeros((height, line), np.uint8)
                lines[:, : 3 * width] = np.repeat(grey, 3, axis=1)
                files.append(header + lines.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=[key, "file"])

    # A file costs far more than its row: tasks get some hundred each and put them in place themselves, not the driver.
    rows = df.select(key, column)
    rows = rows.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows.count() // 500), key)
    made = rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, file binary")
    made.select(key, F.col("file").cast("string").alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(key).text(folder)


def scratch(spark: SparkSession) -> str:
    """A path in the folder that all executors share; what is there goes when the session's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{root or tempfile.mkdtemp(prefix='spark-')}/rasters-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_pixels(raster: Raster, path: str) -> None:
    raster.pixels().write.parquet(path)


def write_rows(raster: Raster, path: str) -> None:
    raster.array_rows().write.parquet(path)
