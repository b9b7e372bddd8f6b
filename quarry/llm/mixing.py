"""Mixing sources to target weights by systematic sampling.

Sources in code point order, null last, weigh 5, 2, 1 and so on in turn.  They
share 150 % of all words; a target stops at twice its source's size and the
excess is shared again by weight until no target is above.  Within a source
every document expects target / size copies.  Documents stand in order of
size, so neighbours in the prefix sum are alike in size and the words taken
miss the target by no more than about one largest document.  One offset per
source, drawn from the seed and the source's name, is added, and a document is
emitted once per integer boundary its span of the prefix sum crosses.

Defined results: texts of any length are counted whole; a null or empty text has size 0 and takes 0 words; a null
source is one source of its own; repeated rows count and are placed one by
one; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize, ranked, size_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def source_key(source: Column) -> Column:
    """A never-null key that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add weight and target to a table of (src, source_size); each round of resharing is one aggregate of two sums."""
    place = F.col("src_rank") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    sources = materialize(ranked(sources, ["src"], "src_rank").withColumn("weight", weight), "sources")
    cap, w = CAP * F.col("source_size"), F.col("weight")
    total, all_weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wanted, full, left, level, before = share * total, 0, all_weight, 0.0, None
    while left and full != before:
        level = (wanted - full) / left
        before = full
        full, left = sources.agg(
            F.coalesce(F.sum(F.when(F.lit(level) * w >= cap, cap)), F.lit(0)), F.coalesce(F.sum(F.when(F.lit(level) * w < cap, w)), F.lit(0))
        ).first()
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * w))


def copies(docs: DataFrame, seed: int = 17, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs: doc_id, src, size, source_size, target, copies."""
    sizes = materialize(docs.select("doc_id", source_key(F.col("source")).alias("src"), size_words().alias("size")), "sizes")
    placed = ranked(sizes, ["src", "size", "doc_id"], "place")
    sources = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = targets(sources, share, weights)
    n_sources = sources.count()
    starts = placed.groupBy("src").agg(F.min("place").alias("first"))
    sources = sources.join(starts, "src")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("src"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("place") - F.col("first")
    return (
        placed.join(broadcast_if_small(sources, n_sources), "src")
        .withColumn("copies", F.least(F.lit(CAP), F.floor(each * (at + 1) + offset) - F.floor(each * at + offset)).cast("int"))
        .select("doc_id", "src", "size", "source_size", "target", "copies")
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    return copies(docs, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    turn = Window.partitionBy("doc_id", "src", "size")
    chosen = copies(docs, **options).withColumn("turn", F.row_number().over(turn.orderBy("copies"))).filter("copies > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col("source")).alias("src"), size_words().alias("size"), "doc_id")
    keyed = keyed.withColumn("turn", F.row_number().over(turn.orderBy(F.xxhash64("row.text"))))
    same = (
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("a.src") == F.col("b.src"))
        & (F.col("a.size") == F.col("b.size"))
        & (F.col("a.turn") == F.col("b.turn"))
    )
    joined = keyed.alias("a").join(chosen.alias("b"), same)
    return joined.select("a.row.*", F.explode(F.sequence(F.lit(1), F.col("b.copies"))).alias("quarry__copy")).drop("quarry__copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
k AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, sum(2 * source_size) OVER w - 2 * source_size AS full_before, sum(weight) OVER () - (sum(weight) OVER w - weight) AS left_weight,
        sum(source_size) OVER () AS total FROM k WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (1.5::DOUBLE * total - full_before) / left_weight AS level FROM o),
l AS (SELECT (SELECT level FROM f WHERE level * weight < 2 * source_size ORDER BY 2.0 * source_size / weight, source NULLS LAST LIMIT 1) AS level),
t AS (SELECT k.source, k.source_size, least(2.0::DOUBLE * k.source_size, coalesce(l.level * k.weight, 2.0::DOUBLE * k.source_size)) AS target,
  list_sum(list_transform(range(1, 13), lambda i: (strpos('0123456789abcdef', substr(md5('17:' || CASE WHEN k.source IS NULL THEN '1' ELSE '0' || k.source END), i::BIGINT, 1)) - 1) * pow(16, 12 - i))) / 281474976710656.0 AS u FROM k CROSS JOIN l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS r FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(2, floor(e * r + u) - floor(e * (r - 1) + u)) * size)::BIGINT AS taken FROM p
"""
