"""Merkle manifest of a dataset with inclusion proofs by coordinate lookup.

Each row is a leaf. The leaves of a source, in the order of their ids, are a tree: every 16
consecutive nodes become their parent, until one is left, the source's root. The sources' roots, in
the order of the sources, are one more tree, whose root stands for the dataset. All nodes are
materialised, a table a level, with their coordinates: tree, level (the table) and place.

A proof is looked up by coordinates: each node's place and the size of its level give the places of
the others of its run, these are exploded and joined with the level's nodes, put in order and
concatenated to what stands left and right of the node. Above its own level a leaf has the siblings
of its parent, which has those of its own parent, and so on: these are looked up once a node and
handed down, so that a node near the root is looked up by the 15 beside it, not by all leaves. The
root is folded from a leaf and its siblings.

Leaves are numbered over ranges of (source, id), so a source of any size is dealt over all tasks, and
nodes move by their run, which has 16 of them.

Defined cases: nulls are marked in the leaf, so a null is not the empty text; a null source is a tree
of its own, first in order; rows alike in source and id (nulls before others) are ordered by their
digest, and repeated rows are leaves of their own; a lone leaf is its source's root, and has the
siblings of the sources only, the lone one of the whole table none; very long texts are hashed whole
and do not move; an empty table gives no rows; other columns are not part of a leaf, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import keep, quoted

#: Nodes of a run, which have one parent.
FANOUT = 16
#: What a leaf is the digest of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranges and sources whose places are broadcast: some 50 bytes each, besides the source's name.
BROADCAST_RANGES = 200_000


def field(value: Column) -> Column:
    """A field as a leaf takes it: its UTF-8 bytes' count and itself, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree`` (the rank of its group, null first) and ``idx`` (its place there), and the groups: ``group``, tree and n.

    Rows are sorted into ranges, and counted by range and group; a place is the rows of the group in
    earlier ranges and the place within this one. The windows over counts see a row a range and group.
    """
    ranged = keep(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(group).asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()))
    counts = keep(ranged.groupBy("part", group).agg(F.count(F.lit(1)).alias("n")))
    names = counts.groupBy(group).agg(F.sum("n").alias("n")).withColumn("tree", F.row_number().over(Window.orderBy(F.col(group).cast("binary").asc_nulls_first())).cast("long") - 1)
    names = keep(names)
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("before", F.coalesce(earlier, F.lit(0).cast("long"))).drop("n").alias("s").join(names.alias("g"), F.expr(f"s.`{group}` <=> g.`{group}`"))
    starts = keep(starts.select("s.part", F.col(f"s.`{group}`").alias("named"), "s.before", "g.tree", "g.n"))
    small = starts.count() <= BROADCAST_RANGES
    place = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    within = ranged.withColumn("place", place)
    joined = within.alias("r").join((F.broadcast(starts) if small else starts).alias("s"), F.expr(f"r.part = s.part AND r.`{group}` <=> s.named"))
    return joined.select("r.*", "s.tree", "s.n", (F.col("s.before") + F.col("r.place")).alias("idx")).drop("part", "place"), names


def levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The levels of all trees from the leaves (tree, idx, n, node) up; ``most`` is the largest n."""
    found = [leaves.select("tree", "idx", "n", "node")]
    while most > 1:
        runs = found[-1].filter("n > 1").groupBy("tree", F.expr(f"idx div {FANOUT}").alias("idx"))
        parents = runs.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("run"))
        found.append(keep(parents.select("tree", "idx", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.unhex(F.sha2(_hex_of("run"), 256)).alias("node"))))
        most = -(-most // FANOUT)
    return found


def _hex_of(run: str | Column) -> Column:
    """The digests of an ordered run as one hex text."""
    return F.lower(F.array_join(F.transform(run, lambda x: F.hex(x["node"])), ""))


def with_siblings(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """``nodes`` with ``step``: the digests left and right of the node in its run.

    Coordinates are (tree, run, idx). Nodes and those looked up move by (tree, run) only, so the
    exploded coordinates are joined and gathered where they are made: the places are compared among
    the 16 of a run, since a third key of the join would move what was exploded.
    """
    run = F.expr(f"idx div {FANOUT}").alias("run")
    own = [c for c in nodes.columns if c not in ("tree", "idx")]
    dealt = nodes.select("tree", run, "idx", F.struct(*own).alias("own")).repartition("tree", "run")
    places = F.expr(f"filter(sequence(run * {FANOUT}, least(run * {FANOUT} + {FANOUT - 1}, own.n - 1)), x -> x != idx)")
    asked = dealt.withColumn("at", F.explode_outer(places))
    told = others.select("tree", run, F.col("idx").alias("at"), "node").repartition("tree", "run")
    found = asked.alias("a").join(told.alias("t"), F.expr("a.tree = t.tree AND a.run = t.run AND a.at - t.at = 0"), "left").select("a.*", "t.node")
    beside = F.when(F.col("node").isNotNull(), F.struct(F.col("at").alias("idx"), "node"))
    gathered = found.groupBy("tree", "run", "idx").agg(F.first("own").alias("own"), F.array_sort(F.collect_list(beside)).alias("run_of"))
    left = _hex_of(F.filter("run_of", lambda x: x["idx"] < F.col("idx")))
    right = _hex_of(F.filter("run_of", lambda x: x["idx"] > F.col("idx")))
    return gathered.select("tree", "run", "idx", "own.*", F.struct(left.alias("left"), right.alias("right")).alias("step"))


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The proofs of the lowest level's nodes, given as ``found[0]`` with any columns beside tree, idx, n and node.

    A proof is an array of steps from the node to the root. ``above`` has the ``path`` of each tree's
    root; its other columns are handed down with it.
    """
    handed, path = [c for c in above.columns if c != "tree"], None
    for level in reversed(found):
        tops = level.filter("n = 1").join(above, "tree")
        if path is not None:
            stepped = with_siblings(level.filter("n > 1"), level.filter("n > 1").select("tree", "idx", "node"))
            parents = path.withColumnRenamed("idx", "run")
            tops = tops.unionByName(stepped.join(parents, ["tree", "run"]).withColumn("path", F.concat(F.array("step"), "path")).drop("run", "step"))
        path = tops if level is found[0] else keep(tops.select("tree", "idx", *handed))
    return path


def fold(start: Column, path: Column) -> Column:
    """The root from a digest (hex) and its path."""
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def siblings_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one hex text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "source", order: str = "doc_id", presented: dict[str, Column] | None = None) -> DataFrame:
    """One row a leaf: key, order, ``leaf``, ``subroot``, ``root``, ``path`` and ``folded_root``.

    ``presented`` replaces fields of the rows that are shown for verification, by columns of ``docs``;
    ``folded_root`` comes from them and the path of the untampered tree.
    """
    shown = presented or {}
    own = leaf(*[quoted(f) for f in fields])
    rows = docs.select(quoted(order).alias("id"), quoted(key).alias("key"), F.unhex(own).alias("node"), F.unhex(leaf(*[shown.get(f, quoted(f)) for f in fields])).alias("seen"))
    # Texts are hashed once; digests are what is sorted and moved. The row's number parts repeated rows.
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()))
    leaves, trees = numbered(rows, "key", [F.col("id").asc_nulls_first(), F.col("node"), F.col("row")])
    leaves = keep(leaves)
    first, count = levels(leaves, trees.agg(F.max("n")).first()[0] or 0), trees.count()
    roots = first[0].filter("n = 1")
    for level in first[1:]:
        roots = roots.unionByName(level.filter("n = 1"))
    tops = keep(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "node"))
    upper = levels(tops, count)
    root = upper[-1].select(F.lower(F.hex("node"))).first() if count else None
    end = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = paths([tops.withColumn("subroot", F.lower(F.hex("node"))), *upper[1:]], end).select(F.col("idx").alias("tree"), "path", "subroot")
    proven = paths([leaves.drop("row"), *first[1:]], keep(above))
    return proven.select("key", "id", F.lower(F.hex("node")).alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", fold(F.lower(F.hex("seen")), F.col("path")).alias("folded_root"))
