"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words. A document's expected copies are its source's target over its
source's size. Whole copies are certain; the rest of the expectation is the inclusion probability p
of one more copy, and these copies go to the documents that come first in Pareto order: the order of
(u / (1 - u)) / (p / (1 - p)) with u a seeded uniform number of the document. The sample is of fixed
size in words: it ends where the source's target is reached, and one closing document, the one whose
size comes nearest to the words still missing, replaces the one at the border.

The border is found without sorting a source: words are summed in fixed cells of the order, the cell
of the border is found on those sums, and only that cell is sorted.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, last
in order; rows alike in every column are counted and numbered, and each number has a draw of its own;
ties in the order go by the draw; a very long text counts whole, and a target that it would overshoot ends with the
nearest closing document; an empty table gives no rows; other columns, whatever their names, pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import WORD_PATTERN, free_name, keep, on_plain_names, without_maps
from gleaner.llm.ngram_join import sifted

#: Cells of the Pareto order in which words are summed, for each source.
CELLS = 65536
GROUP = 256
#: Copies of a row that are made again by one row of the plan.
COPIES = 4096


def word_count(column: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(*columns: str, seed: int = 0) -> F.Column:
    """The seeded hash of a document from which its uniform number is taken."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def uniform(hashed: F.Column) -> F.Column:
    """A number above 0 and below 1 from the upper 52 bits of a hash."""
    return (F.shiftrightunsigned(hashed, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Words for each source: (source, source_size) gains ``target``.

    Sources in code point order, null last, take the weights in turn. A target above ``most`` times
    its source stops there and the excess goes to the others by weight, until none is above. That
    ends in one level w with target = min(most * size, w * weight), found from the sources in the
    order in which they fill up. The input has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("full", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    full_before, weight_before = F.coalesce(F.sum("full").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - full_before) / (F.sum("weight").over(everything) - weight_before)
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("full") <= F.col("level") * F.col("weight"))
    # Sources after the last capped one all have the level that the first of them has.
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("full") / F.col("weight"), F.col("level")))).over(everything)
    return leveled.select("source", "source_size", F.when(F.col("capped"), F.col("full")).otherwise(rest["level"] * F.col("weight")).cast("double").alias("target"))


def pareto_plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source: what decides the copies of its documents.

    ``rows`` has source, size and draw; ``targets`` has source, source_size and target. The result
    holds source, source_size, target, whole, chance, and the border: cell, odds and closing draw.
    """
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A rate within rounding of a whole number is that number.
    whole = F.floor(expected + F.lit(1e-9))
    rates = targets.withColumn("whole", whole.cast("long")).withColumn("chance", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    rates = rates.withColumn("chance", F.when(F.col("chance") > 1e-9, F.col("chance")).otherwise(F.lit(0.0)))
    rates = rates.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    drawn = rows.groupBy("source", "draw").agg(F.sum("size").alias("size"))
    drawn = drawn.alias("d").join(rates.filter("chance > 0").alias("r"), F.expr("d.source <=> r.source")).select("d.source", "d.draw", "d.size", "r.rest", odds("d.draw", "r.chance").alias("odds"))
    drawn = drawn.withColumn("cell", cell("odds"))

    # First among groups of cells, then among the cells of one group: no source sends more than GROUP rows to a task.
    cells = drawn.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    groups = cells.groupBy("source", (F.col("cell") / GROUP).cast("int").alias("group")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    in_group = _border(groups.withColumn("taken", F.lit(0)), "group")
    fine = cells.alias("c").join(in_group.alias("g"), F.expr(f"c.source <=> g.source AND int(c.cell / {GROUP}) = g.border")).select("c.source", "c.cell", "c.words", "c.rest", "g.taken")
    border = _border(fine, "cell")

    inside = drawn.alias("d").join(border.alias("b"), F.expr("d.source <=> b.source AND d.cell = b.border")).select("d.source", "d.odds", "d.draw", "d.size", "d.rest", "b.taken")
    upto = F.col("taken") + F.sum("size").over(Window.partitionBy("source").orderBy("odds", "draw").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).filter("upto <= rest").groupBy("source").agg(F.max(F.struct("odds", "upto")).alias("l")).select("source", F.col("l.odds").alias("last"), F.col("l.upto").alias("reached"))

    ends = border.alias("b").join(last.alias("l"), F.expr("b.source <=> l.source"), "left").select("b.source", "b.border", F.coalesce("l.last", F.lit(-1.0)).alias("last"), F.coalesce("l.reached", "b.taken").alias("reached"))
    left = drawn.alias("d").join(ends.alias("e"), F.expr("d.source <=> e.source AND (d.cell > e.border OR (d.cell = e.border AND d.odds > e.last))")).select("d.source", "d.draw", "d.odds", F.abs(F.col("d.size") - (F.col("d.rest") - F.col("e.reached"))).alias("off"), (F.col("d.rest") - F.col("e.reached")).alias("gap"))
    closing = left.filter("off < gap").groupBy("source").agg(F.min(F.struct("off", "odds", "draw")).alias("c")).select("source", F.col("c.draw").alias("closing"))

    plan = rates.alias("r").join(ends.alias("e"), F.expr("r.source <=> e.source"), "left").join(closing.alias("c"), F.expr("r.source <=> c.source"), "left")
    return plan.select("r.source", "r.source_size", "r.target", "r.whole", "r.chance", "e.border", "e.last", "c.closing")


def _border(sums: DataFrame, place: str) -> DataFrame:
    """(source, border, taken): the place at which each source's words pass its rest, and the words before it."""
    upto = F.col("taken") + F.sum("words").over(Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    passed = sums.withColumn("upto", upto).filter("upto > rest")
    first = passed.groupBy("source").agg(F.min(F.struct(place, (F.col("upto") - F.col("words")).alias("taken"))).alias("b"))
    return first.select("source", F.col(f"b.{place}").alias("border"), F.col("b.taken").alias("taken"))


def odds(drawn: str, chance: str) -> F.Column:
    u, p = uniform(F.col(drawn)), F.col(chance)
    return (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))


def cell(odds_column: str) -> F.Column:
    """The cell of a place in the order: odds from 0 to infinity go to 0 to CELLS - 1."""
    q = F.col(odds_column)
    return F.least(F.floor(q / (F.lit(1.0) + q) * CELLS), F.lit(CELLS - 1)).cast("int")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, draw and more) with source_size, target and ``copies``."""
    joined = rows.alias("x").join(plan.alias("p"), F.expr("x.source <=> p.source"))
    more = joined.select("x.*", "p.source_size", "p.target", "p.whole", "p.chance", "p.border", "p.last", "p.closing")
    more = more.withColumn("odds", F.when(F.col("chance") > 0, odds("draw", "chance"))).withColumn("cell", cell("odds"))
    extra = F.expr("chance > 0 AND (border IS NULL OR cell < border OR (cell = border AND odds <= last) OR coalesce(draw = closing, false))")
    return more.withColumn("copies", F.col("whole") + extra.cast("long")).drop("whole", "chance", "border", "last", "closing", "odds", "cell")


def measured(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size and draw of each document; the draw is that of the whole row."""
    return docs.select("doc_id", "source", word_count().alias("size"), draw(*docs.columns, seed=seed).alias("draw"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, in which the second, third, ... of equal rows have a ``draw`` of their own.

    Equal rows combine before they move, and are made again from their count in runs of COPIES.
    """
    at, copies = free_name(rows, "at", "copies")
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(copies))
    runs = counted.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES).cast("long"))))
    each = runs.withColumn("number", F.explode(F.sequence(F.col(at), F.least(F.col(at) + COPIES, F.col(copies)) - 1)))
    return each.select(*[c for c in rows.columns if c != "draw"], F.when(F.col("number") == 0, F.col("draw")).otherwise(F.xxhash64("draw", "number")).alias("draw"), "number")


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    sizes = rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    return keep(pareto_plan(rows, keep(source_targets(sizes, weights, share, most))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 0) -> DataFrame:
    """The mixed corpus: each document as often as its copies say, with its own columns."""

    def mixed(plain: DataFrame) -> DataFrame:
        flat, back = without_maps(plain)
        return back(_mix(flat, weights, share, most, seed))

    return on_plain_names(docs, mixed, "doc_id", "text", "source")


def _mix(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    first = measured(docs, seed)
    rows = keep(numbered(first.withColumn("base", F.col("draw"))))
    plan = mix_plan(rows, weights, share, most)
    again = keep(rows.filter("number = 1").select(F.col("base").alias("draw")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), "source", draw(*docs.columns, seed=seed).alias("draw"))
    if not again.isEmpty():
        # Only rows that may be repeated are dealt and numbered; all others pass where they are.
        once, more = sifted(whole, again, "draw", among=False), numbered(sifted(whole, again, "draw"))
        whole = once.unionByName(more.select(*once.columns))
    return with_copies(whole, plan).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
