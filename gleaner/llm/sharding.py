"""Sharding by a two-pass external shuffle.

Pass one scatters the rows uniformly, by a seeded hash, into buckets that fit in a task's memory.
Pass two shuffles each bucket with Spark's ``shuffle`` (a Fisher-Yates permutation) and lays the
buckets one behind the other; equal ranges of that order are the shards. Every step is a DataFrame
function.

A row that is repeated so often that its copies would overfill a bucket is first counted, and its
copies are scattered by their numbers. Copies are made again from the count, so they cross the
network once, like any row, and no task holds all of them.

Defined cases: an empty table gives no rows; null ids, texts and other columns are hashed like any
value; equal rows get places of their own; a very long text is one row of its bucket, which is larger
by it; input columns named shard or slot are kept, and the added ones get underscores before their
names; maps are taken as their entries, so rows alike but for the order of those are two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import free_name, keep, on_plain_names, without_maps

#: Bytes of rows that a bucket holds on average, at most.
BUCKET_BYTES = 128 << 20
#: Buckets a shard at least, so that small tables are dealt to several tasks too.
BUCKETS_PER_SHARD = 1
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: A repeated row is counted if its copies have more than a bucket's bytes by this.
HOT_SHARE = 4
#: Copies that are made again by one row of the plan.
COPIES = 4096
#: Buckets whose places are broadcast: 32 bytes each.
BROADCAST_BUCKETS = 1_000_000


def text_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a text (null: none) and the fixed share of its row."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def external_shuffle(df: DataFrame, shards: int, size: F.Column | None = None, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, by: list[F.Column] | None = None) -> DataFrame:
    """The rows of ``df`` in a seeded random order, with ``shard`` (0 to ``shards`` - 1) and ``slot``.

    The shards' row counts are at most one apart, and the slots of each run from 0 without a gap.
    ``size`` measures a row; the sum of it decides how many buckets there are. ``by`` is what a row's
    hash is taken of, all columns if it is not given. The rows come out bucket by bucket, so each output
    file holds a contiguous range of few shards.
    """
    measured, hashed = free_name(df, "measured", "hashed")
    added = {measured: text_bytes() if size is None else size}
    if by is not None:
        added[hashed] = F.xxhash64(F.lit(seed), *by)

    def shuffled(plain: DataFrame) -> DataFrame:
        flat, back = without_maps(plain)
        return back(_shuffle(flat, shards, measured, hashed, seed, bucket_bytes))

    return on_plain_names(df.withColumns(added), shuffled, *added)


def _shuffle(df: DataFrame, shards: int, size: str, hashed: str, seed: int, bucket_bytes: int) -> DataFrame:
    columns = [c for c in df.columns if c not in (size, hashed)]
    bucket, key, held, rows, cell, at, before, total, copy, shard, slot = free_name(df, "bucket", "key", "bytes", "rows", "cell", "at", "before", "total", "copy", "shard", "slot")
    keyed = df.withColumnRenamed(hashed, key) if hashed in df.columns else df.withColumn(key, F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]))
    # Eight bytes a row and two counts, combined before they move; all later counts come from here.
    tally = keep(keyed.groupBy(key).agg(F.sum(size).alias(held), F.count(F.lit(1)).alias(rows)))
    every = tally.agg(F.sum(held).alias("bytes"), F.sum(rows).alias("rows")).first()
    buckets = max(1, shards * BUCKETS_PER_SHARD, -(-(every["bytes"] or 0) // bucket_bytes))
    target = max(1, (every["bytes"] or 0) // buckets)
    scatter = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(buckets)).cast("int")

    # At most HOT_SHARE * buckets keys, as each of them has that share of a bucket's bytes.
    often = keep(tally.filter((F.col(rows) > 1) & (F.col(held) * HOT_SHARE > target)).select(key, rows))
    plain, hot = keyed, None
    count_of = tally
    if not often.isEmpty():
        few = F.broadcast(often.select(key)) if HOT_SHARE * buckets <= BROADCAST_BUCKETS else often.select(key)
        plain, count_of = keyed.join(few, key, "left_anti"), tally.join(few, key, "left_anti")
        # Equal rows combine before the shuffle: a few rows a task, whatever the number of copies.
        once = keyed.join(few, key, "left_semi").groupBy(key, *columns).agg(F.count(F.lit(1)).alias(rows))
        heaps = once.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rows) - 1, F.lit(COPIES).cast("long"))))
        heaps = heaps.repartition(F.col(key), F.col(at))
        hot = heaps.withColumn(copy, F.explode(F.sequence(F.col(at), F.least(F.col(at) + COPIES, F.col(rows)) - 1))).withColumn(bucket, scatter(key, copy))
    scattered = plain.withColumn(bucket, scatter(key)).select(bucket, *columns)
    counts = count_of.groupBy(scatter(key).alias(bucket)).agg(F.sum(rows).alias(total))
    if hot is not None:
        scattered = scattered.unionByName(hot.select(bucket, *columns))
        counts = counts.unionByName(hot.groupBy(bucket).agg(F.count(F.lit(1)).alias(total))).groupBy(bucket).agg(F.sum(total).alias(total))

    # One row per bucket, not per record: this window sees a row for every bucket_bytes of input.
    ends = counts.select(bucket, (F.sum(total).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col(total)).alias(before))
    ends = F.broadcast(ends) if buckets <= BROADCAST_BUCKETS else ends

    filled = scattered.repartitionById(buckets, bucket).groupBy(bucket).agg(F.collect_list(F.struct(*columns)).alias(cell))
    shuffled = filled.join(ends, bucket).select(before, F.posexplode(F.shuffle(F.array_sort(cell), F.lit(seed))).alias(at, cell))
    # Integer arithmetic: shard s owns the places from ceil(s * total / shards) on.
    n = every["rows"] or 1
    place = f"(`{before}` + `{at}`)"
    of = f"({place} * {shards} div {n})"
    return shuffled.select(f"{cell}.*", F.expr(of).cast("int").alias(shard), F.expr(f"{place} - ({of} * {n} + {shards} - 1) div {shards}").cast("long").alias(slot))


def write_shards(df: DataFrame, path: str) -> None:
    """Write a shuffled table, one folder a shard; the rows of a file keep their slots' order."""
    df.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
