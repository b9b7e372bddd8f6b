"""Tables in the shared folder, and ranks that need no single partition."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where none is configured and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex[:12]}"


SMALL = 8  # tables of ids and parameters go into so many times fewer files


def materialize(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and lost executors cost nothing.

    A small table (ids or parameters, no texts) is written by a share of the
    shuffle's partitions, so that loops don't leave thousands of tiny files.
    """
    path = scratch_path(df.sparkSession, name)
    if small:
        df = df.coalesce(max(1, -(-partitions(df.sparkSession) // SMALL)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more, and let Spark drop the shuffle files of finished phases."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Remove every intermediate table of this and earlier sessions; call it when no result is still to be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 20_000) -> DataFrame:
    """A broadcast hint only where the counted rows stay under the limit; beyond it the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if rows <= limit else df


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Add a dense 0-based global rank by the columns of order.

    Range partitions are numbered locally as they are written; the rank of a
    partition's first row is the prefix sum of the counts before it (one
    number per partition reaches the driver).
    """
    spark = df.sparkSession
    n = partitions(spark)
    placed = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    )
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    base, bases = 0, []
    for p in sorted(counts):
        bases.append((int(p), base))
        base += counts[p]
    if not bases:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    first = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))  # one row per partition
    return (
        placed.withColumn("_part", part)
        .join(first, "_part")
        .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_base", "_at")
    )
