"""Test plans for findings on live targets. Plans are text; nothing is run."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import shell_quote

# Categories with a target that can be tested, and the texts of a plan.
LIVE_CATEGORIES = ("network", "webapp")
COMMAND = ("python3 -m live_check ", " --objective ", " --i-am-authorized")


def is_live(category: Column, target: Column) -> Column:
    return category.isin(*LIVE_CATEGORIES) & (F.coalesce(target, F.lit("")) != "")


def first_text(candidates: Column) -> Column:
    """Of the first candidate: its translation, else its text, else its title."""
    first = F.try_element_at(candidates, F.lit(1))
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(first["text_zh"]), blank(first["text"]), first["title"])


def requirement(status: Column, reference: Column, clauses: Column, articles: Column, recommendation: Column | None = None) -> Column:
    """Where a plan's requirement comes from: the rule and its recommendation, else the first clause, else the first article."""

    def of(source: str, candidates: Column) -> Column:
        first = F.try_element_at(candidates, F.lit(1))
        return F.struct(F.lit(source).alias("source"), first["key"].alias("id"), first_text(candidates).alias("text"))

    ruled = (status == "matched") & (F.coalesce(reference, F.lit("")) != "")
    rule = F.struct(F.lit("rule").alias("source"), reference.alias("id"), F.coalesce(F.lit(None).cast("string") if recommendation is None else recommendation, F.lit("")).alias("text"))
    return F.when(ruled, rule).when(F.size(clauses) > 0, of("iec", clauses)).when(F.size(articles) > 0, of("cra", articles))


def objective(target: Column, service: Column, title: Column, requirement_id: Column) -> Column:
    """The objective when no text was generated for the finding."""
    name = F.coalesce(F.nullif(service, F.lit("")), title, F.lit(""))
    basis = F.when(F.coalesce(requirement_id, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" (requirement "), requirement_id, F.lit(")")))
    return F.concat(F.lit("With authorisation, verify whether "), name, F.lit(" on "), F.coalesce(target, F.lit("")), F.lit(" can be exploited"), basis)


def command(target: Column, aim: Column) -> Column:
    return F.concat(F.lit(COMMAND[0]), shell_quote(target), F.lit(COMMAND[1]), shell_quote(aim), F.lit(COMMAND[2]))


def test_plan(merged: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Plan rows of the live findings; ``generated`` (finding_id, objective) has texts for some of them."""
    live = merged.filter(is_live(F.col("category"), F.col("target")))
    advice = F.col("recommendation") if "recommendation" in merged.columns else None
    basis = requirement(F.col("status"), F.col("cra_reference"), F.col("clauses"), F.col("articles"), advice)
    live = live.withColumn("requirement", basis)
    fallback = objective(F.col("target"), F.col("service"), F.col("title"), F.col("requirement.id"))
    live = live.join(generated.select("finding_id", F.col("objective").alias("made")), "finding_id", "left") if generated is not None else live.withColumn("made", F.lit(None).cast("string"))
    aim = F.coalesce("made", fallback)
    return live.select("finding_id", "target", "title", "category", "status", "requirement", aim.alias("objective"), F.col("made").isNotNull().alias("objective_from_llm"), command(F.col("target"), aim).alias("command"))


#: Lines of a plan's text; this project's own wording.
PLAN_TITLE, PLAN_WARNING, PLAN_EMPTY = "# Test plan", "Run a command only on a target that you are authorised to test.", "No finding is on a target that can be tested."


def plan_blocks(rows: DataFrame, order: str = "seq") -> DataFrame:
    """(target, ord, text): one Markdown block a planned test; ``rows`` are those of ``test_plan`` with an order."""
    required = F.when(F.coalesce("requirement.id", F.lit("")) == "", F.lit("none, a general aim")).otherwise(F.concat(F.col("requirement.id"), F.lit(" ("), F.col("requirement.source"), F.lit(")")))
    aim = F.concat(F.when(F.col("objective_from_llm"), F.lit("- aim: ")).otherwise(F.lit("- aim (from a template): ")), F.col("objective"))
    lines = [F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), F.lit(""), F.concat(F.lit("- target: `"), F.col("target"), F.lit("`, status: "), F.col("status")), F.concat(F.lit("- requirement: "), required), aim, F.lit(""), F.lit("```bash"), F.col("command"), F.lit("```")]
    return rows.select("target", F.col(order).alias("ord"), F.concat_ws("\n", *lines).alias("text"))


def plan_header(rows: DataFrame, now: str) -> DataFrame:
    """One row with what stands before all blocks; the time is given, so that reruns agree."""
    n = F.count(F.lit(1))
    count = F.concat(F.lit(f"made at {now}, "), n.cast("string"), F.lit(" tests"))
    return rows.agg(F.concat_ws("\n\n", F.lit(PLAN_TITLE), count, F.lit(PLAN_WARNING), F.when(n == 0, F.lit(PLAN_EMPTY))).alias("text"))
