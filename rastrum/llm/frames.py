"""Spark helpers shared by the corpus operators: tables, shared files, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many "_" before them as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine may leave it unnamed (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses. What is there goes when the session's JVM ends."""
    root = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    where, files = _files(spark, root)
    files.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path. What the write has shuffled goes with its end, as no other
    plan reads it; the session's own setting of that is put back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, None)
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(clean) if before is None else spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Stored tables of one step, which go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        table, path = stored(df, name)
        old = self.paths.get(name)
        self.paths[name] = path
        if old:
            discard(self.spark, old)
        return table

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    where, files = _files(spark, path)
    files.delete(where, True)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch to ``most``: rows are whole documents here, and this setting, read when a
    plan runs, is all that bounds what a task holds of them at a time. A smaller value of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def map_arrow(
    df: DataFrame,
    function: Callable[[Iterable[pa.RecordBatch]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns; ``schema`` is Spark DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            arrays = [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def text_batches(batches: Iterable[pa.RecordBatch], most_bytes: int = 4_000_000) -> Iterator[tuple[dict[str, list], list[str]]]:
    """Slices of Arrow batches (column lists and texts, null as "") of bounded text size, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy()
        lot = np.cumsum(sizes + 64, dtype=np.int64) // most_bytes
        edges = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            columns = batch.slice(low, high - low).to_pydict()
            yield columns, [t or "" for t in columns.pop("text")]


def crc_mod(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null ids count as the empty text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def skew_join(big: DataFrame, small: DataFrame, key: str | list[str], count: str, how: str = "inner", share: int = 2000) -> DataFrame:
    """Join on ``key`` where ``small`` knows in ``count``, alike in all rows of a key, how many rows of ``big`` the key has.

    A key with more than 1/``share`` of all counted rows is dealt over as many parts as it has such shares, by a hash
    of the whole row; its rows of ``small`` go to each part. There are at most ``share`` such keys, so the list of
    them is broadcast at every size. ``big`` is read once.
    """
    keys = [key] if isinstance(key, str) else key
    total = small.select(*keys, count).distinct().agg(F.sum(count).alias("n")).first()["n"] or 0
    parts = F.greatest(F.ceil(F.col(count) * F.lit(share) / F.lit(max(total, 1))), F.lit(1))
    hot = small.where(parts > 1).select(*keys, parts.alias("__parts")).distinct()
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(F.xxhash64(*big.columns), F.coalesce("__parts", F.lit(1))))
    spread = small.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.drop("__parts").join(spread, [*keys, "__part"], how).drop("__part")


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges reduced to one star for each of their components: a group of k nodes leaves as k - 1 edges."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        if batch.num_rows:
            a, b = spanning_forest(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            yield {"a": a, "b": b}


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges by alternating large-star and small-star steps.

    Returns (node, component) for every node that occurs in an edge; component is the least node.
    Every round is one table in the shared folder; nothing is gathered on the driver but counts. The root of
    a large component has as many edges as members, so its key is dealt over many parts.
    """
    spark = edges.sparkSession
    stars, path = stored(map_arrow(edges.select("a", "b").where("a <> b"), _forest, "a long, b long"), "edges")
    seen = None
    for _ in range(most_rounds):
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0")
        large = skew_join(both.where("b > a"), least.select("a", F.least("a", "m").alias("m"), "n"), "a", "n")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new, new_path = stored(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(spark, path)
        stars, path = new, new_path
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
