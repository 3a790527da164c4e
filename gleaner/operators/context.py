"""Reference context for generated texts: formatting, packing under a budget, allowed sources."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import CLAUSE_CHARS, CLAUSE_MARK, clause_key, strip, truncate

# Separator, budget and the note on what was left out.
SEPARATOR = "\n\n---\n\n"
CONTEXT_CHARS = 12_000
MITIGATIONS = "官方建議緩解措施："
DROPPED_NOTE = ("（另有 ", " 筆相關性較低的候選因長度限制未列入）")


def clause_entry(number: Column, title: Column, group: Column, text: Column, prefix: str = "") -> Column:
    """A header with the number, the title unless it is the number, and the group; then the text."""
    own, family = (strip(F.coalesce(c, F.lit(""))) for c in (title, group))
    titled = F.when((own == "") | (own == number), F.lit("")).otherwise(F.concat(F.lit(" — "), own))
    grouped = F.when(family == "", F.lit("")).otherwise(F.concat(F.lit("（"), family, F.lit("）")))
    return F.concat(F.lit(f"[{prefix}"), F.coalesce(number, F.lit("?")), titled, grouped, F.lit("]\n"), truncate(text))


def weakness_entry(number: Column, name: Column, text: Column, mitigations: Column) -> Column:
    """A header, the description and the listed mitigations; parts without text are left out."""
    own = strip(F.coalesce(name, F.lit("")))
    header = F.concat(F.lit("["), F.coalesce(number, F.lit("?")), F.when(own == "", F.lit("")).otherwise(F.concat(F.lit(" — "), own)), F.lit("]"))
    bullets = F.transform(F.coalesce(mitigations, F.array().cast("array<string>")), lambda m: F.concat(F.lit("- "), truncate(m)))
    listed = F.when(F.size(bullets) > 0, F.concat(F.array(F.lit(MITIGATIONS)), bullets)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(F.concat(F.array(header, truncate(text)), listed), lambda p: p != ""), "\n")


def pack(blocks: Column, budget: int = CONTEXT_CHARS) -> Column:
    """Struct of the joined text, how many blocks are in it and how many are not.

    A fold in order: a block that doesn't fit is left out and later ones may still fit; the first
    always goes in; each one that does counts the separator too.
    """
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"), F.lit(0).alias("dropped"))

    def add(state: Column, block: Column) -> Column:
        skip = (state["total"] + F.length(block) > budget) & (F.size(state["kept"]) > 0)
        return F.struct(
            F.when(skip, state["kept"]).otherwise(F.array_append(state["kept"], block)).alias("kept"),
            F.when(skip, state["total"]).otherwise(state["total"] + F.length(block) + len(SEPARATOR)).alias("total"),
            (state["dropped"] + skip.cast("int")).alias("dropped"),
        )

    def finish(state: Column) -> Column:
        note = F.concat(F.lit(DROPPED_NOTE[0]), state["dropped"].cast("string"), F.lit(DROPPED_NOTE[1]))
        whole = F.when(state["dropped"] > 0, F.array_append(state["kept"], note)).otherwise(state["kept"])
        return F.struct(F.array_join(whole, SEPARATOR).alias("text"), F.size(state["kept"]).alias("n_kept"), state["dropped"].alias("n_dropped"))

    return F.aggregate(blocks, zero, add, finish)


def source_ids(weaknesses: Column, articles: Column, clauses: Column) -> Column:
    """The numbers that a generated text may cite, in that order, without blanks."""
    return F.filter(F.concat(weaknesses, articles, clauses), lambda x: F.coalesce(x, F.lit("")) != "")


def pack_groups(entries: DataFrame, by: str, order: str, block: str, budget: int = CONTEXT_CHARS) -> DataFrame:
    """One packed context a group. Groups are the candidates of one finding, a few blocks each."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block])
    return entries.groupBy(by).agg(ordered.alias("blocks")).select(by, pack(F.col("blocks"), budget).alias("p")).select(by, "p.*")


def clause_index(entries: DataFrame, number: Column, order: Column, text: Column) -> DataFrame:
    """(clause, body): the text of each clause number, of several the last one that is not blank."""
    rows = entries.select(clause_key(number).alias("clause"), order.alias("at"), strip(text).alias("body")).filter("body <> ''")
    return rows.groupBy("clause").agg(F.max_by("body", "at").alias("body"))


def with_clause_text(rows: DataFrame, index: DataFrame, reference: Column, name: str = "clause_text") -> DataFrame:
    """``rows`` with the text of the clause that they refer to, cut to what a prompt takes; blank without one.

    Texts are cut once a clause, before they are joined, not once a row.
    """
    cut = index.select("clause", truncate(F.col("body"), CLAUSE_CHARS, CLAUSE_MARK).alias("body"))
    keyed = rows.withColumn("_clause", clause_key(reference)).alias("r")
    found = keyed.join(cut.alias("i"), F.expr("r._clause = i.clause"), "left")
    return found.select("r.*", F.coalesce("i.body", F.lit("")).alias(name)).drop("_clause")
