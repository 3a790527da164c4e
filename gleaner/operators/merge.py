"""Merging findings with their analysis, and ranking, grouping and summing up by target."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.scoring import level_rank
from gleaner.storage import keep

# What a scan category adds to the process query, and how many titles do.
CATEGORY_PHRASES = {
    "network": "exposed network services and remote access interfaces of a product",
    "firmware": "firmware image contents, embedded binaries, keys and update packages",
    "webapp": "web application interfaces and their reported vulnerabilities",
}
PROCESS_TITLES = 15
SCOPE_CATEGORIES = ("network", "firmware", "webapp")


def last_analysis(analysis: DataFrame, key: str = "finding_id", order: str = "seq") -> DataFrame:
    """Of several analyses of a finding, the last. An aggregate, so that hot keys combine before the shuffle."""
    rest = [c for c in analysis.columns if c != key]
    return analysis.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def merge(findings: DataFrame, analysis: DataFrame, key: str = "finding_id", order: str = "seq") -> DataFrame:
    """All findings with the last analysis of each; without one the status is no_match and the risk info."""
    columns = [c for c in analysis.columns if c not in (key, order)]
    merged = findings.join(last_analysis(analysis, key, order).select(key, *columns), key, "left")
    return merged.withColumns({"status": F.coalesce("status", F.lit("no_match")), "risk_level": F.coalesce("risk_level", F.lit("info"))})


def by_risk(merged: DataFrame, order: str = "seq") -> DataFrame:
    """A stable sort by risk."""
    return merged.orderBy(level_rank(F.col("risk_level")), order)


def numbered(rows: DataFrame, level: str, order: str, name: str) -> DataFrame:
    """``rows`` numbered from 1 by level, then by order, without one task seeing all."""
    return numbered_within(rows, [], [level, order], name)


def numbered_within(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in each group, without one task seeing all of a large group.

    Rows are dealt into ranges of about equal size, which are written once. They are numbered within
    their range; a group that goes on in further ranges adds what the earlier ones hold of it, which
    is a sum over a row a range.
    """
    cell, here, before = "_cell", "_here", "_before"
    dealt = keep(rows.repartitionByRange(*by, *order).withColumn(cell, F.spark_partition_id()))
    counts = dealt.groupBy(*by, cell).agg(F.count(F.lit(1)).alias(here))
    earlier = F.sum(here).over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn(before, F.coalesce(earlier, F.lit(0))).drop(here)
    within = F.row_number().over(Window.partitionBy(cell, *by).orderBy(*order))
    numbered = dealt.withColumn(name, within).alias("r")
    same = " AND ".join(f"r.`{c}` <=> o.`{c}`" for c in (cell, *by))
    kept = [F.col(f"r.`{c}`") for c in rows.columns]
    return numbered.join(offsets.alias("o"), F.expr(same)).select(*kept, (F.col(f"r.`{name}`") + F.col(f"o.`{before}`")).cast("int").alias(name))


def target_ranks(merged: DataFrame, order: str = "seq") -> DataFrame:
    """Adds the place of each target, by its first row in risk order, and of each row in its target.

    Rows are dealt once into ranges of risk order, which serve both ranks. A row's place in its target is
    its place there within the range and the target's rows in earlier ranges; a target's place is that of
    its first row among the first rows of its range, and the targets that begin in earlier ones.
    """
    level, cell, here, before, first = "_level", "_cell", "_here", "_before", "_first"
    leveled = merged.withColumn(level, level_rank(F.col("risk_level")))
    dealt = keep(leveled.repartitionByRange(level, order).withColumn(cell, F.spark_partition_id()))
    counts = dealt.groupBy("target", cell).agg(F.count(F.lit(1)).alias(here), F.min(F.struct(F.col(level), F.col(order).alias("at"))).alias(first))
    of_target = Window.partitionBy("target").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = keep(counts.withColumn(before, F.coalesce(F.sum(here).over(of_target), F.lit(0))))
    # A target begins in the range before which it has no rows.
    begun = counts.filter(F.col(before) == 0).select("target", cell, first)
    per_cell = begun.groupBy(cell).agg(F.count(F.lit(1)).alias(here))
    earlier = per_cell.select(F.col(cell).alias("at"), (F.sum(here).over(Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)) - F.col(here)).alias("_targets"))
    place = F.row_number().over(Window.partitionBy(cell).orderBy(first))
    ranked = begun.withColumn("_place", place).join(earlier, F.col(cell) == F.col("at")).select("target", (F.col("_place") + F.col("_targets")).cast("int").alias("group_rank"))
    told = counts.alias("c").join(ranked.alias("k"), F.expr("c.target <=> k.target")).select("c.target", F.col(f"c.{cell}").alias("_at"), F.col(f"c.{before}").alias(before), "k.group_rank")
    within = F.row_number().over(Window.partitionBy("target", cell).orderBy(level, order))
    rows = dealt.withColumn("item_rank", within).alias("r").join(told.alias("t"), F.expr(f"r.target <=> t.target AND r.{cell} = t._at"))
    return rows.select(*[F.col(f"r.`{c}`") for c in merged.columns], "t.group_rank", (F.col("r.item_rank") + F.col(f"t.{before}")).cast("int").alias("item_rank"))


def scope_rows(findings: DataFrame) -> DataFrame:
    """(category, target): the distinct targets of the three categories, for scans of any size."""
    return findings.filter(F.col("category").isin(*SCOPE_CATEGORIES)).select("category", "target").distinct()


def scope(findings: DataFrame) -> DataFrame:
    """The distinct targets of each category, sorted and joined; the three categories always there.

    It is a line of a report, so one row holds all targets; ``scope_rows`` has them as rows.
    """
    columns = [F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("target")))), ", "), F.lit("")).alias(c) for c in SCOPE_CATEGORIES]
    return findings.select("category", "target").distinct().agg(*columns)


def process_query(findings: DataFrame, run: str, order: str = "seq") -> DataFrame:
    """One query text a run: phrases of its categories and its first titles, each once, in order of appearance."""
    phrase = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_PHRASES.items() for x in kv]), F.col("category")), F.col("category"))
    kinds = findings.filter("coalesce(category, '') <> ''").groupBy(run, "category").agg(F.min(order).alias("at"))
    kinds = kinds.select(run, F.lit(0).alias("part"), "at", phrase.alias("piece"))
    titles = findings.withColumn("title", F.trim("title")).filter("coalesce(title, '') <> ''").groupBy(run, "title").agg(F.min(order).alias("at"))
    titles = titles.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("at"))).filter(F.col("place") <= PROCESS_TITLES)
    pieces = kinds.unionByName(titles.select(run, F.lit(1).alias("part"), "at", F.col("title").alias("piece")))
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "piece")))
    return pieces.groupBy(run).agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("query"))
