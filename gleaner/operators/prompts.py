"""Prompts of generated texts, as columns. The wording is this project's own; what goes in is fixed by the kind of text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import CLAUSE_CHARS, detail_lines, reference_id, reference_note

NO_CLAUSE, NO_CLAUSE_TEXT = "(none is listed)", "(its text is not at hand; go by the number and the note)"
NO_CONTEXT, NO_CANDIDATE, NO_REASON, NO_ADVICE, NO_BASIS = "(nothing was found)", "(no candidate)", "(not given)", "(none)", "(none given)"


def _text(part: Column | str) -> Column:
    return F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit(""))


def _block(*lines: Column) -> Column:
    """Lines that are not null, one below the other."""
    return F.concat_ws("\n", *lines)


def finding_part(target: bool = True, severity: bool = False) -> Column:
    """The finding itself: title, category, source, target and severity as asked for, and its details."""
    lines = [F.lit("# Finding"), F.concat(F.lit("- title: "), _text("title")), F.concat(F.lit("- category: "), _text("category"), F.lit(" ("), _text("source"), F.lit(")"))]
    lines += [F.concat(F.lit("- target: "), _text("target"))] if target else []
    lines += [F.concat(F.lit("- severity: "), _text("severity"))] if severity else []
    return _block(*lines, F.nullif(detail_lines(F.col("detail")), F.lit("")))


def advice_prompt(context: Column) -> Column:
    """Asks for a judgement of a finding with the packed context of its candidates."""
    own = F.when(F.trim(_text(context)) == "", F.lit(NO_CONTEXT)).otherwise(context)
    return _block(finding_part(severity=True), F.lit(""), F.lit("# Reference material; cite nothing else"), own)


def remediation_prompt(reference: Column) -> Column:
    """Asks what a finding needs to meet one candidate."""
    return _block(finding_part(), F.lit(""), _text(reference))


def _candidate(kind: str, number: Column, title: Column, text: Column) -> Column:
    found = F.concat_ws("\n", F.concat(_text(number), F.lit(" — "), _text(title)), F.left(_text(text), F.lit(CLAUSE_CHARS)))
    return _block(F.lit(f"# Candidate {kind}"), F.when(number.isNull(), F.lit(NO_CANDIDATE)).otherwise(found))


def summary_prompt(weakness: Column, clause: Column, article: Column) -> Column:
    """Asks for a summary from the best candidate (key, title, text) of each knowledge base; any may be null."""
    parts = [_candidate(kind, c["key"], c["title"], c["text"]) for kind, c in (("weakness", weakness), ("clause", clause), ("article", article))]
    return F.concat_ws("\n\n", finding_part(), *parts)


def clause_block(heading: str, reference: Column, text: Column) -> Column:
    """What a prompt says of a clause that a finding refers to: its number, the report's note on it, and its text or that there is none."""
    number, note = reference_id(reference), reference_note(reference)
    told = F.when(note != "", F.concat(F.lit("(the report says: "), note, F.lit(")")))
    body = F.coalesce(F.concat(F.lit("Text:\n"), F.nullif(text, F.lit(""))), F.lit(NO_CLAUSE_TEXT))
    return _block(F.lit(f"# {heading}"), F.when(number == "", F.lit(NO_CLAUSE)).otherwise(_block(number, told, F.lit(""), body)))


def rule_prompt(reason: Column, clause_text: Column, article_text: Column, advice: Column) -> Column:
    """Asks to rewrite a rule's advice against its clauses; the target has no part in it."""
    filled = lambda c, instead: F.coalesce(F.nullif(c, F.lit("")), F.lit(instead))
    return F.concat_ws("\n\n", finding_part(target=False), _block(F.lit("# Why it is a weakness"), filled(reason, NO_REASON)), F.nullif(_text(clause_text), F.lit("")), F.nullif(_text(article_text), F.lit("")), _block(F.lit("# The rule's advice"), filled(advice, NO_ADVICE)))


def name_prompt(advice: Column, reference: Column) -> Column:
    """Asks for a short name of a confirmed weakness."""
    lines = F.concat_ws("\n", F.when(_text(advice) != "", F.concat(F.lit("- remediation: "), advice)), F.when(_text(reference) != "", F.concat(F.lit("- reference: "), reference)))
    return F.concat_ws("\n\n", finding_part(target=False), _block(F.lit("# What was found"), F.when(lines == "", F.lit(NO_BASIS)).otherwise(lines)))


def objective_prompt(requirement: Column) -> Column:
    """Asks for the aim of a test; ``requirement`` is a struct with id and text, or null."""
    related = F.when(requirement.isNotNull(), _block(F.lit("# Requirement to test"), F.concat(F.lit("- "), _text(requirement["id"]), F.lit(": "), _text(requirement["text"]))))
    return F.concat_ws("\n\n", finding_part(), related)
