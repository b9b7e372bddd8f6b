"""Near-duplicate documents by min-max hashing.

A document's set of word shingles is hashed by 100 permutations and both the
least and the greatest value of each are kept: 200 values for 100 hash
evaluations a shingle.  40 bands of 5 values are bucket keys, bands of least
and of greatest values apart; a pair of similarity s shares no bucket with
probability (1 - s**5)**40, which is 1.3e-7 at 0.8.  Every link is confirmed
on the full shingle sets.

Groups of any size are handled without forming their pairs:

1. documents with equal sets form one class, and its smallest doc_id stands
   for it from then on;
2. each bucket has a pseudo-random leader; its members are checked against the
   leader only, and confirmed links give components.  Buckets that still hold
   several components get new leaders, ``rounds`` times in all;
3. what may still be missing are links between components that share a
   bucket.  Of the documents in such buckets, two can only be similar enough if
   their sets share a shingle within their prefixes: the first n - 0.8 n + 1
   shingles in one order of all shingles, rarest first (counted in a table of
   fixed size; any order is exact, a rare one meets less).  Pairs of different
   components that meet there, and whose places and sizes still allow the
   similarity, are counted exactly.  A pair's documents lie in tiles of their
   family (the largest component they share a bucket with), and a tile of
   pairs gets each of its documents' shingles once.

So every pair of different texts that shares a bucket is linked if it is similar
enough, without forming the pairs of a bucket.

Defined results: null or empty texts have an empty set and link with nothing;
a text of fewer words than a shingle has one shingle of all its words; rows
with a null doc_id link with nothing (their component is null) and are kept;
rows of one doc_id count as one document, but in ``dedup`` those of different
texts don't; texts are hashed whole; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize, ranked
from .graph import components
from .kernel import LOWER, Words, mix, run_hash, slices, trim

BANDS, ROWS = 40, 5
TILE = 64  # documents of a family in one tile
SLOTS = 1 << 18  # of the table that counts shingles


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(71))
    return rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the documents' offsets among them."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    at = words.windows(width)
    values, docs = [run_hash(hashes, width)[at]], [words.doc[at]]
    for n in range(1, width):
        short = np.flatnonzero(words.count == n)
        if len(short):
            values.append(run_hash(hashes, n, n)[words.first[short]])
            docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[first], doc[first]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit hash of the set (s1, s2) and the band keys."""
    evaluations = bands * rows // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, factor = permutations(evaluations)
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                value, at = shingle_sets(data, off, width)
                count = np.diff(at)
                full = np.flatnonzero(count)
                keys = np.zeros((len(full), bands), np.uint64)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(full):
                    begin = at[full]
                    s1[full] = np.add.reduceat(mix(value), begin)
                    s2[full] = np.add.reduceat(mix(value + np.uint64(0x51ED270B)), begin)
                    low = np.empty((evaluations, len(full)), np.uint64)
                    high = np.empty_like(low)
                    for k in range(evaluations):
                        h = (value ^ flip[k]) * factor[k]
                        np.minimum.reduceat(h, begin, out=low[k])
                        np.maximum.reduceat(h, begin, out=high[k])
                    both = np.concatenate([low, high])
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for r in range(rows):
                            key = mix(key ^ both[b * rows + r])
                        keys[:, b] = key
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "n": count.astype(np.int64),
                        "s1": s1.view(np.int64),
                        "s2": s2.view(np.int64),
                        "keys": pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]), pa.int32()), pa.array(keys.view(np.int64).ravel())
                        ),
                    }
                )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def _linked(value: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity; a and b index documents."""
    out = np.zeros(len(a), bool)
    for k, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = value[at[p] : at[p + 1]], value[at[q] : at[q + 1]]
        if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        out[k] = 100 * both >= percent * (len(x) + len(y) - both)
    return out


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for i in range(0, n, 256):
                part = batch.slice(i, 256)
                whole = pc.equal(part.column(2), part.column(3))  # equal texts have equal sets
                yield pa.RecordBatch.from_pydict({"a": part.column(0).filter(whole), "b": part.column(1).filter(whole)})
                part = part.filter(pc.invert(whole))
                m = part.num_rows
                texts_ = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks()
                sets, offs = [], [np.zeros(1, np.int64)]
                for _, _, data, off in slices(texts_):
                    value, at = shingle_sets(data, off, width)
                    sets.append(value)
                    offs.append(at[1:] + offs[-1][-1])
                if not m:
                    continue
                good = _linked(np.concatenate(sets), np.concatenate(offs), np.arange(m), np.arange(m, 2 * m), percent)
                yield pa.RecordBatch.from_pydict({"a": part.column(0).filter(pa.array(good)), "b": part.column(1).filter(pa.array(good))})

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _stars(members: DataFrame, salt: int, percent: int) -> DataFrame:
    """(a, b): members of a bucket beside its leader of this round, where components and sizes leave something to check."""
    mask = F.xxhash64("key", F.lit(salt))
    code = F.min(F.struct(F.col("doc_id").bitwiseXOR(mask).alias("code"), F.col("n").alias("na"), F.col("component").alias("other")))
    leaders = materialize(members.groupBy("key").agg(code.alias("lead")).select("key", F.col("lead.code").bitwiseXOR(mask).alias("a"), "lead.na", "lead.other"), "leaders")
    pairs = members.join(leaders, "key").filter(
        (F.col("component") != F.col("other")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na"))
    )
    return pairs.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their component and its size."""
    sized = labels.join(labels.groupBy("component").agg(F.count("*").alias("size")), "component")
    at = materialize(members.select("key", "doc_id", "n").join(sized, "doc_id"), "at")
    keys = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("size", "component")).alias("main"))
    keys = materialize(keys.filter("lo < hi").select("key", F.col("main.size").alias("main_size"), F.col("main.component").alias("main")), "open")
    out = materialize(at.join(keys, "key"), "members")
    delete(members.sparkSession, at, keys)
    return out


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, component, tile, sh) of (doc_id, component, tile, text): sh has the distinct shingles, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(3)):
                value, at = shingle_sets(data, off, width)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(3)], lists], ["doc_id", "component", "tile", "sh"])

    return texts.select("doc_id", "component", "tile", "text").mapInArrow(run, "doc_id long, component long, tile long, sh array<long>")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component, tile, n, sh, at): the shingles of each set's prefix and their places in it."""
    spark = sets.sparkSession
    slot = F.col("s").bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    counted = sets.select(F.explode("sh").alias("s")).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).toArrow()  # SLOTS rows at most
    table = np.zeros(SLOTS, np.int64)
    table[np.asarray(counted["slot"])] = np.asarray(counted["n"])
    shared = spark.sparkContext.broadcast(np.minimum(table, (1 << 31) - 1).astype(np.int32))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = shared.value
        for batch in batches:
            value = np.asarray(batch.column(3).flatten()).view(np.uint64)
            n = np.asarray(batch.column(3).value_lengths()).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((value, times[(value & np.uint64(SLOTS - 1)).astype(np.int64)], doc))
            first = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(len(value)) - first[doc]
            short = place < (n - -(-percent * n // 100) + 1)[doc]
            pick, own = order[short], doc[short]
            take = pa.array(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(take),
                    "component": batch.column(1).take(take),
                    "tile": batch.column(2).take(take),
                    "n": n[own],
                    "sh": value[pick].view(np.int64),
                    "at": place[short],
                }
            )

    rows = sets.select("doc_id", "component", "tile", "sh")
    return rows.mapInArrow(run, "doc_id long, component long, tile long, n long, sh long, at long")


def _meetings(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ta, tb): pairs of different components that may be similar enough, with their tiles."""
    rows = materialize(_prefixes(sets, percent), "prefixes")
    mixed = rows.groupBy("sh").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sh")
    rows = materialize(rows.join(mixed, "sh", "left_semi"), "mixed")
    side = lambda x: rows.select("sh", *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "component", "tile", "n", "at")])
    # what two sets share at most if they first meet at these places, against what the similarity asks for
    most = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    may = (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))
    sizes = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    pairs = side("a").join(side("b"), "sh").filter((F.col("a_component") < F.col("b_component")) & sizes & may)
    return pairs.groupBy(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).agg(F.first("a_tile").alias("ta"), F.first("b_tile").alias("tb"))


def _counted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, ta, tb) whose sets are similar enough; a tile of pairs gets each set once."""
    pairs = materialize(pairs, "meetings", small=True)
    side = lambda x: pairs.select("ta", "tb", F.col(x).alias("doc_id")).distinct()
    held = side("a").union(side("b")).distinct().join(sets.select("doc_id", "sh"), "doc_id")
    rows = pairs.select("ta", "tb", "a", "b", F.lit(None).cast("array<long>").alias("sh")).unionByName(
        held.select("ta", "tb", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "sh")
    )

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_set = np.asarray(rows["b"].is_null())
        sets_, want = rows.filter(pa.array(is_set)), rows.filter(pa.array(~is_set))
        lists = sets_["sh"].combine_chunks()
        value = np.asarray(lists.flatten()).view(np.uint64)
        at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))])
        ids = np.asarray(sets_["a"])
        order = np.argsort(ids)
        a, b = np.asarray(want["a"]), np.asarray(want["b"])
        x, y = (order[np.searchsorted(ids[order], e)] for e in (a, b))
        good = _linked(value, at, x, y, percent)
        trim()
        return pa.table({"a": a[good], "b": b[good]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.groupBy("ta", "tb").applyInArrow(run, "a long, b long").distinct()  # a shuffle, so that few files follow many tasks


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, rounds: int = 1) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id linked), kept."""
    spark = docs.sparkSession
    signed = materialize(signatures(docs, width, bands, rows), "signatures")
    sound = signed.filter("doc_id is not null and n > 0")
    classes = materialize(sound.groupBy("s1", "s2").agg(F.min("doc_id").alias("class")), "classes", small=True)
    heads = classes.select(F.col("class").alias("doc_id")).distinct()
    keyed = sound.join(heads, "doc_id", "left_semi").select("doc_id", "n", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key"), "shared")
    members = materialize(keyed.join(shared, "key").distinct(), "members")
    delete(spark, shared)
    same = sound.join(classes, ["s1", "s2"]).filter(F.col("doc_id") != F.col("class")).select(F.col("class").alias("a"), F.col("doc_id").alias("b"))
    same = materialize(same.distinct(), "same", small=True)
    needed = members.select("doc_id").union(same.select("a")).union(same.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
    texts = materialize(texts, "texts")

    links = spark.createDataFrame([], "a long, b long")
    labels = members.select("doc_id", F.col("doc_id").alias("component")).distinct()
    now = members.withColumn("component", F.col("doc_id"))
    for salt in range(rounds):
        found = materialize(confirm(_stars(now, salt, percent), texts, width, percent), "found", small=True)
        if salt and not found.limit(1).count():
            break
        labels = _labels(members, links.union(found))
        links = labels.filter("doc_id <> component").select(F.col("component").alias("a"), F.col("doc_id").alias("b"))
        now = _open(members, labels)

    # what may be missing: links between components that share a bucket
    family = now.groupBy("doc_id", "component").agg(F.max(F.struct("main_size", "main")).alias("m"), F.max("size").alias("size"))
    sizes = family.groupBy("m.main").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    turn = F.pmod(F.xxhash64("doc_id"), F.col("tiles"))
    placed = family.withColumn("main", F.col("m.main")).join(sizes, "main").select("doc_id", "component", F.xxhash64("main", turn).alias("tile"))
    sets = materialize(_sets(texts.join(placed, "doc_id"), width), "sets")
    last = materialize(_counted(_meetings(sets, percent), sets, percent), "last", small=True)
    grouped = components(links.union(last).union(confirm(same, texts, width, percent)))
    delete(spark, members, now, texts, sets)
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _labels(members: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnRenamed("node", "doc_id")
    ids = members.select("doc_id").distinct()
    return materialize(ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")), "components", small=True)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept: one document of each group; repeated rows of a kept doc_id and text once.

    Different texts under one doc_id are documents of their own here; where there are any, ranks in order of doc_id stand for the ids.
    """
    names, id_ = docs.columns, F.col("doc_id").cast("long")
    docs = docs.withColumn("quarry__text", F.xxhash64("text"))
    nulls, others = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    differ = F.min("quarry__text") != F.max("quarry__text")
    if others.groupBy(id_.alias("quarry__gone")).agg(differ.alias("differ")).filter("differ").head(1):
        own = others.select(id_.alias("quarry__gone"), F.col("quarry__text").alias("quarry__hash")).distinct()
        own = materialize(ranked(own, ["quarry__gone", "quarry__hash"], "quarry__rank"), "ids")
        same = (id_ == F.col("quarry__gone")) & (F.col("quarry__text") == F.col("quarry__hash"))
        rows = materialize(others.join(own, same).select(F.col("quarry__rank").alias("doc_id"), "text"), "texts")
        gone = near_duplicates(rows, **options).filter("not kept").select(F.col("doc_id").alias("quarry__rank"))
        gone = own.join(gone, "quarry__rank", "left_semi")
    else:
        same = id_ == F.col("quarry__gone")
        gone = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("quarry__gone")).distinct()
    kept = others.join(gone, same, "left_anti").dropDuplicates(["doc_id", "quarry__text"])
    return kept.select(names).unionByName(nulls.select(names))


#: For width 2 and unique doc ids.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node AND r.root < e.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
