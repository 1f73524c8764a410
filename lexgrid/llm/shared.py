"""Reading tables, cutting lineage and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder of its
    own; on a cluster that is an error, as executors see no folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lexgrid-shared-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lexgrid-{kind}-{uuid.uuid4().hex}"


def _at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver's JVM delete a folder when it ends, unless it is gone by then."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def _freed(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing needs any more.

    It does so once the driver's JVM has collected what refers to them.  Events
    that still wait for listeners refer to the last query, and some references
    go only after Spark's cleaner has seen what a first collection found.
    """
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5000)
    except Py4JJavaError:  # a slow listener: files go a stage later
        pass
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def staged(df: DataFrame, kind: str, free: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps neither recompute it nor depend on an executor's disk.

    A table that a result still reads stays until the driver ends.  free: large
    shuffles stand behind df; their files are deleted.
    """
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    _at_exit(df.sparkSession, path)
    if free:
        _freed(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later step reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    for file in df.inputFiles()[:1]:
        deleted(spark, file.rsplit("/", 1)[0])


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: So many texts of clashing ids are sent to all tasks; more are joined by a shuffle.
CLASHES = 1000


def text_hash(text: str) -> Column:
    return F.xxhash64(text)


def with_rid(documents: DataFrame, text: str = "text", rid: str = "rid") -> DataFrame:
    """documents with a 64-bit id of each text, different for different texts.

    Ids are hashes.  A second hash finds those that different texts share (some
    24 are to be expected among 3e10 texts); such texts get an id made of both.
    """
    hashed = documents.withColumn(rid, text_hash(text))
    check = F.xxhash64(F.lit("check"), text)
    its_id, clashing = free_names(hashed, "clash_id", "clashes")
    ids = hashed.select(F.col(rid).alias(its_id), check.alias("check"))
    clashes = ids.groupBy(its_id).agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select(its_id, F.lit(True).alias(clashing))
    n = clashes.limit(CLASHES + 1).count()
    if n == 0:
        return hashed
    joined = hashed.join(F.broadcast(clashes) if n <= CLASHES else clashes, F.col(rid) == F.col(its_id), "left")
    own = F.when(F.col(clashing), F.xxhash64(check, F.col(rid))).otherwise(F.col(rid))
    return joined.withColumn(rid, own).drop(its_id, clashing)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: pairs of long ids; nulls and loops are ignored.  Returns (node,
    component), one row per id that stands in an edge to another id, component
    being the smallest id reachable.  Every step is a shuffle by node over rows
    already distinct, and is staged, so that no task holds a component.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = staged(now, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = staged(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, now)
        now = after
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen
