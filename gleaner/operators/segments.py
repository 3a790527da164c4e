"""Segmentation of numbered texts: line noise, clauses with sections, and paragraphs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import joined_lines
from gleaner.storage import keep

# The line patterns of the two standards and their page furniture.
CLAUSE = {
    "4-2": r"^(\d+(?:\.\d+)+)\s+((?:CR|EDR|HDR|NDR|SAR)\s+\d+\.\d+)\s*[–—-]\s*(.+)$",
    "4-1": r"^(\d+(?:\.\d+)+)\s+((?:SM|SR|SD|SI|SVV|DM|SUM|SG)-\d+)\s*[:：]\s*(.+)$",
}
GROUP = {
    "4-2": r"^\d+\s+(FR\s+\d+\s*[–—-]\s*.+|(?:Software application|Embedded device|Host device|Network device)\s+requirements)$",
    "4-1": r"^\d+\s+(Practice\s+\d+\s*[–—-]\s*.+)$",
}
STANDARDS = {"4-2": "IEC 62443-4-2", "4-1": "IEC 62443-4-1"}
SECTION = r"(?i)^\d+(?:\.\d+)+\s+(Requirement enhancements|Requirements enhancements|Rationale and supplemental guidance|Security levels|Requirement)\s*$"
SECTION_FIELDS = {"requirement": "requirement", "rationale and supplemental guidance": "rationale", "requirement enhancements": "enhancements", "requirements enhancements": "enhancements", "security levels": "security_levels"}
NOISE = (r"^(–\s*\d+\s*–\s*)?IEC\s+62443-\d-\d:\d{4}.*?(–\s*\d+\s*–)?$", r"\.{4,}\s*\d+\s*$", r"(?i)^Customer:\s", r"(?i)^Order No\.:", r"(?i)licence agreement", r"(?i)copyright of IEC", r"^\s*$")
BODY_START = r"^1\s+Scope\s*$"
LANGUAGE_BOUNDARY = r"^(SOMMAIRE|AVANT-PROPOS)$"
BLOCK_START = r"^(\(\d+\)|[a-z]\)|\d+\)|[•●▪◦‣]|NOTE\b|EXAMPLE\b|SL-C\b)"
#: Ranges of documents whose states are broadcast: some hundred bytes each.
BROADCAST_RANGES = 200_000
LICENCE_LEAK = r"(?i)licence agreement|copyright of IEC|Customer:\s|Order No\.:"


def is_noise(line: Column) -> Column:
    found = F.lit(False)
    for pattern in NOISE:
        found = found | line.rlike(pattern)
    return found


def upright_lines(glyphs: DataFrame, doc: str = "doc_id", n: str = "n", text: str = "text", upright: str = "upright") -> DataFrame:
    """Lines put together from runs of glyphs in order, without those that stand askew, such as watermarks."""
    kept = glyphs.filter(F.coalesce(F.col(upright), F.lit(True)))
    runs = F.array_sort(F.collect_list(F.struct("run", text)))
    return kept.groupBy(doc, n).agg(F.array_join(F.transform(runs, lambda r: r[text]), "").alias("line"))


def body_lines(lines: DataFrame, doc: str = "doc_id", n: str = "n", line: str = "line") -> DataFrame:
    """A document's lines before a second language and from its body's start on, without noise.

    The two limits are aggregates of one row a document, joined back; no document is sorted.
    """
    limits = lines.groupBy(doc).agg(F.min(F.when(F.col(line).rlike(LANGUAGE_BOUNDARY), F.col(n))).alias("stop"), F.min(F.when(F.col(line).rlike(BODY_START), F.col(n))).alias("start"))
    # A start behind the stop is none.
    limits = limits.withColumn("start", F.when(F.col("stop").isNull() | (F.col("start") < F.col("stop")), F.col("start")))
    kept = lines.join(limits, doc).filter((F.col("stop").isNull() | (F.col(n) < F.col("stop"))) & (F.col("start").isNull() | (F.col(n) >= F.col("start"))))
    return kept.filter(~is_noise(F.col(line))).drop("start", "stop")


def of_part(part: Column, value: Callable[[str], Column]) -> Column:
    """``value`` of the standard that a row's part names; null for any other part."""
    cases = F.lit(None)
    for name in STANDARDS:
        cases = F.when(part == name, value(name)).otherwise(cases)
    return cases


def detect_part(name: Column) -> Column:
    """The part of the standard that a file's name tells, or null."""
    own = F.replace(F.lower(F.regexp_extract(name, r"([^/\\\\]*)$", 1)), F.lit("_"), F.lit("-"))
    return F.coalesce(*[F.when(own.contains(f"62443-{part}"), part) for part in STANDARDS])


def clause_lines(lines: DataFrame, doc: str = "doc_id", n: str = "n", line: str = "line", part: Column | str = "4-2") -> DataFrame:
    """Each line of a clause with the clause's number in the document, its header parts, group and field.

    ``part`` is a standard's part or a column of it; each part has headers of its own.

    A group header names the group of later clauses and does not end the one it stands in. Lines
    before the first clause, and headers, are dropped.

    Lines are dealt by ranges of (document, line), so a document of any length goes to many tasks. Each
    range is summed up by the state it ends in (group, clauses, the last clause's head, field), as far
    as the range tells it; these are composed over a document's ranges, a row a range, and complete
    the state within the next ones.
    """
    own = F.col(line)
    part = F.lit(part) if isinstance(part, str) else part
    found = lambda patterns: F.coalesce(of_part(part, lambda k: own.rlike(patterns[k])), F.lit(False))
    piece = lambda patterns, i: of_part(part, lambda k: F.regexp_extract(own, patterns[k], i))
    is_group = found(GROUP)
    is_clause = ~is_group & found(CLAUSE)
    is_section = ~is_group & ~is_clause & own.rlike(SECTION)
    squash = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    field = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_FIELDS.items() for x in kv]), F.lower(F.regexp_extract(own, SECTION, 1)))
    head = F.when(is_clause, F.struct(piece(CLAUSE, 1).alias("clause_no"), squash(piece(CLAUSE, 2)).alias("clause_id"), F.trim(piece(CLAUSE, 3)).alias("title")))
    marked = lines.select(F.col(doc).alias("doc"), F.col(n).alias("n"), own.alias("line"), F.when(is_group, squash(piece(GROUP, 1))).alias("group"), head.alias("head"), F.when(is_section, F.struct(field.alias("name"))).alias("section"))
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(marked.repartitionByRange(parts, "doc", "n").withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("doc", "range").orderBy("n")
    so_far = lambda c: F.last(c, ignorenulls=True).over(within)
    local = ranged.withColumns({"clauses": F.sum(F.col("head").isNotNull().cast("long")).over(within), "is_header": F.coalesce(F.col("group"), F.col("head.clause_no"), F.when(F.col("section").isNotNull(), "")).isNotNull(), "group": so_far(F.col("group"))})
    # A clause begins without a field of its own, and has the group so far.
    state = F.when(F.col("head").isNotNull(), F.struct(F.lit(None).cast("string").alias("name"))).otherwise(F.col("section"))
    local = local.withColumns({"head": so_far(F.when(F.col("head").isNotNull(), F.struct("head.*", F.col("group").alias("group")))), "section": so_far(state)})
    ends = local.groupBy("doc", "range").agg(F.max_by(F.struct("group", "clauses", "head", "section"), "n").alias("end")).select("doc", "range", "end.*")
    earlier = Window.partitionBy("doc").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("group_in", F.last("group", ignorenulls=True).over(earlier))
    ends = ends.withColumn("head", F.when(F.col("head").isNotNull(), _grouped(F.col("head"), F.col("group_in"))))
    carried = keep(ends.select("doc", F.col("range").alias("at"), "group_in", F.coalesce(F.sum("clauses").over(earlier), F.lit(0).cast("long")).alias("clauses_in"), F.last("head", ignorenulls=True).over(earlier).alias("head_in"), F.last("section", ignorenulls=True).over(earlier).alias("section_in")))
    told = F.broadcast(carried) if carried.count() <= BROADCAST_RANGES else carried
    rows = local.alias("l").join(told.alias("c"), F.expr("l.doc <=> c.doc AND l.range = c.at")).select("l.*", "c.group_in", "c.clauses_in", "c.head_in", "c.section_in")
    rows = rows.withColumns({"clause": (F.col("clauses_in") + F.col("clauses")).cast("long"), "head": F.coalesce(F.when(F.col("head").isNotNull(), _grouped(F.col("head"), F.col("group_in"))), F.col("head_in"))})
    rows = rows.filter("clause > 0 AND NOT is_header")
    return rows.select(F.col("doc").alias(doc), "clause", "head.clause_no", "head.clause_id", "head.title", F.coalesce("head.group", F.lit("")).alias("group"), F.coalesce(F.coalesce("section", "section_in")["name"], F.lit("requirement")).alias("field"), F.col("n").alias(n), F.col("line").alias(line))


def _grouped(head: Column, group: Column) -> Column:
    """A head whose group its range tells, or else the ranges before it."""
    return F.struct(head["clause_no"].alias("clause_no"), head["clause_id"].alias("clause_id"), head["title"].alias("title"), F.coalesce(head["group"], group).alias("group"))


def dewrap(lines: Column) -> Column:
    """Lines as paragraphs: a block start begins a new line, a final hyphen is removed and joined, else a space joins."""

    def piece(line: Column, i: Column) -> Column:
        last, following = F.try_element_at(lines, i), F.try_element_at(lines, i + 2)  # positions count from 1
        starts = line.rlike(BLOCK_START)
        before = F.when(i == 0, "").when(starts, "\n").when(F.endswith(last, F.lit("-")), "").otherwise(" ")
        joins = F.endswith(line, F.lit("-")) & F.coalesce(~following.rlike(BLOCK_START), F.lit(False))
        return F.concat(before, F.when(joins, F.left(line, F.length(line) - 1)).otherwise(line))

    # Position 0 is no place of an array, so the first line has none before it.
    return F.regexp_replace(F.array_join(F.transform(lines, lambda line, i: piece(line, F.when(i > 0, i).otherwise(0))), ""), r"(?U)^\s+|\s+$", "")


def clauses(lines: DataFrame, doc: str = "doc_id", part: Column | str = "4-2") -> DataFrame:
    """One row a clause with its four fields dewrapped. A clause is a few pages at most."""
    each = clause_lines(lines, doc, part=part)
    own = lambda name: dewrap(F.transform(F.filter(F.col("all"), lambda x: x["field"] == name), lambda x: x["line"])).alias(name)
    grouped = each.groupBy(doc, "clause", "clause_no", "clause_id", "title", "group").agg(F.array_sort(F.collect_list(F.struct("n", "field", "line"))).alias("all"))
    return grouped.select(doc, "clause", "clause_no", "clause_id", "title", "group", *[own(f) for f in ("requirement", "rationale", "enhancements", "security_levels")])


def clause_records(found: DataFrame, part: Column | str = "4-2") -> DataFrame:
    """Clauses as knowledge-base entries: key, title, labelled text, group, levels and the text to embed."""
    part = F.lit(part) if isinstance(part, str) else part
    standard = of_part(part, lambda k: F.lit(STANDARDS[k]))
    bodies = (("Requirement", "requirement"), ("Rationale and supplemental guidance", "rationale"), ("Requirement enhancements", "enhancements"))
    text = F.array_join(F.array_compact(F.array(*[F.when(F.trim(name) != "", F.concat(F.lit(f"{label}:\n"), F.col(name))) for label, name in bodies])), "\n\n")
    key = F.concat(standard, F.lit(" "), "clause_id")
    # The levels are alike everywhere and would only drown what tells clauses apart.
    embedded = joined_lines(F.concat(key, F.lit(" – "), "title"), "group", *[name for _, name in bodies])
    return found.select(key.alias("key"), "clause_id", "clause_no", standard.alias("standard"), "title", "group", text.alias("text"), "security_levels", embedded.alias("embedding_text"))
