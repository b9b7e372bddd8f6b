"""Statistics of a corpus: sizes, extensions, coverage, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import extension
from ..plans.storage import materialize, partitions, ranked

# Upper bounds of the size buckets.
EDGES = (256 << 10, 1 << 20, 2 << 20, 4 << 20, 8 << 20, 16 << 20, 128 << 20, 1 << 30)
DEFAULT_SIDECAR, LOW_SIDECAR = 8 << 20, 2 << 20


def bucket(size: Column, edges: tuple[int, ...] = EDGES) -> Column:
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(size < edges[i], F.lit(i)).otherwise(out)
    return out


def size_histogram(files: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    return files.groupBy(bucket(F.col("size"), edges).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _by_size(files: DataFrame) -> DataFrame:
    """(size, n): equal sizes counted, so ranks need one row per size, not per file."""
    return files.groupBy("size").agg(F.count("*").alias("n"))


def _upto(sizes: DataFrame) -> DataFrame:
    """Add upto: files of this size or a smaller one, by sums within ranges of sizes and the ranges' sums before them."""
    spark = sizes.sparkSession
    at = materialize(sizes.repartitionByRange(partitions(spark), "size").withColumn("_part", F.spark_partition_id()), "sizes")
    sums = {r["_part"]: r["n"] for r in at.groupBy("_part").agg(F.sum("n").alias("n")).collect()}  # one row per partition
    base, rows = 0, []
    for p in sorted(sums):
        rows.append((p, base))
        base += sums[p]
    before = spark.createDataFrame(rows, "_part int, _before long")
    own = Window.partitionBy("_part").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return at.join(F.broadcast(before), "_part").withColumn("upto", F.sum("n").over(own) + F.col("_before")).drop("_part", "_before")


def concentration(files: DataFrame) -> DataFrame:
    """One row: files, bytes, largest, median (upper), and the shares of the largest 1 % and 2 % of files."""
    sizes = _upto(_by_size(files))
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("size").alias("largest"))
    placed = sizes.crossJoin(F.broadcast(total))  # one row
    above = F.col("files") - F.col("upto")  # files that are larger
    top = lambda p: F.greatest(F.lit(1), F.ceil(F.col("files") * p)).cast("long")
    part = lambda p: F.sum(F.greatest(F.lit(0), F.least(F.col("n"), top(p) - above)) * F.col("size")) / F.max("bytes")
    return placed.agg(
        F.max("files").alias("files"),
        F.max("bytes").alias("bytes"),
        F.max("largest").alias("largest"),
        F.min(F.when(F.col("upto") > F.floor(F.col("files") / 2), F.col("size"))).alias("median"),
        part(0.01).alias("top1"),
        part(0.02).alias("top2"),
    )


def archetype(files: DataFrame) -> DataFrame:
    """One row: the tags of a corpus' shape, the share of its middle sizes and the block threshold over a network."""
    middle = files.agg(
        F.count_if(F.col("size").between(1 << 20, (8 << 20) - 1)).alias("middle_files"),
        F.coalesce(F.sum(F.when(F.col("size").between(1 << 20, (8 << 20) - 1), F.col("size"))), F.lit(0)).alias("middle_bytes"),
        F.count_if(F.col("size") >= 1 << 30).alias("huge"),
    )
    one = concentration(files).crossJoin(F.broadcast(middle))
    share = F.when(F.col("bytes") > 0, F.col("middle_bytes") / F.col("bytes")).otherwise(F.lit(0.0))
    tags = F.concat_ws(
        ", ",
        F.when(F.col("top2") >= 0.6, "byte-heavy"),
        F.when((F.col("files") >= 20000) & (F.col("median") < 4096), "count-heavy"),
        F.when(F.col("huge") > 0, F.concat(F.col("huge").cast("string"), F.lit(" >1GB"))),
    )
    return one.select(
        F.when(tags == "", "ordinary").otherwise(tags).alias("tags"),
        share.alias("middle_share"),
        F.when((share >= 0.04) | (F.col("middle_files") >= 1000), LOW_SIDECAR).otherwise(DEFAULT_SIDECAR).cast("long").alias("network_threshold"),
    )


def extension_census(files: DataFrame, top: int = 12) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ext").limit(top)


def nearest_rank(rows: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key, over counted values."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    placed = counted.withColumn("_u", F.sum("_n").over(w.orderBy(value))).withColumn("_t", F.sum("_n").over(w))
    return placed.groupBy(key).agg(*[F.min(F.when(F.col("_u") >= F.ceil(F.col("_t") * p), F.col(value))).alias(name) for name, p in ps.items()])


def extension_sizes(files: DataFrame) -> DataFrame:
    """Per extension: files, p50, p95, largest and the path of the largest."""
    rows = files.select(extension(F.col("path")).alias("ext"), "size", "path")
    whole = rows.groupBy("ext").agg(
        F.count("*").alias("files"), F.max("size").alias("largest"), F.min_by("path", F.struct(-F.col("size"), F.col("path"))).alias("largest_path")
    )
    return whole.join(nearest_rank(rows, "ext", "size", {"p50": 0.5, "p95": 0.95}), "ext")


def survey(files: DataFrame, symbol_cap: int, file_cap: int) -> DataFrame:
    """One row of counts: indexed files and bytes, files over the symbol cap and over the file cap."""
    kept = F.col("size") <= file_cap
    return files.agg(
        F.count_if(kept).alias("indexed_files"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("indexed_bytes"),
        F.count_if(kept & (F.col("size") > symbol_cap)).alias("over_symbol_cap"),
        F.count_if(~kept).alias("over_file_cap"),
    )


def stride_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows at even strides of the order."""
    total = rows.count()
    picks = sorted({i * total // n for i in range(n)}) if total else []
    return ranked(rows, order, "_r").filter(F.col("_r").isin(picks)).drop("_r")


def round_robin(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add turn and group_size: each group's first row, then each group's second; order by turn and -group_size.

    Ranks come from range partitions and prefix sums, so a large group is many tasks.
    """
    placed = ranked(rows, [group, *order], "_rank")
    groups = placed.groupBy(group).agg(F.min("_rank").alias("_first"), F.count("*").alias("group_size"))
    return placed.join(groups, group).withColumn("turn", (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_rank", "_first")


def first_per(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the least values of order; partial results come before the shuffle."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(F.col(key).alias("_key")).agg(first.alias("_first")).select("_first.*")
