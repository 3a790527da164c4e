"""Text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, marks and separators of assembled texts.
ENTRY_CHARS = 1500
TRUNCATION_MARK = "……（本筆內容過長已截斷，完整條文請見原始法規）"
CLAUSE_CHARS = 4000
CLAUSE_MARK = "……"
REFERENCE_SEPARATOR = " — "
SUMMARY_LABELS = ("弱點名稱", "弱點原因", "修補建議")
STANDARD_PREFIX = r"^iec\s*62443-\d-\d\s+"
#: Citations, one family after the other.
CITATIONS = (
    r"CWE-\d+",
    r"Article\s+\d+",
    r"Annex\s+[IVX]+(?:\s+(?:Part|Class)\s+[IVX]+)?(?:\s*(?:\([a-zA-Z0-9]+\)|\d+(?:\.\d+)*\.?))*",
    r"(?:IEC\s*62443-\d-\d\s+)?(?:CR|EDR|HDR|NDR|SAR)\s*\d+\.\d+(?:\s*RE\s*\(\d+\))?",
    r"(?:IEC\s*62443-\d-\d\s+)?(?:SM|SR|SD|SVV|SUM|SG|DM|SI)-\d+",
)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def tokenize(text: Column) -> Column:
    """All runs of a to z and 0 to 9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def squash(text: Column) -> Column:
    """Any white space, no-break spaces too, as single spaces; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    return F.lower(squash(text))


def squash_paren_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*\(", "(")


def clause_key(reference: Column) -> Column:
    """The form in which clause numbers are compared."""
    bare = F.regexp_replace(F.lower(strip(reference)), r"(?U)^cra\s+", "")
    return F.regexp_replace(squash_paren_space(bare), r"(?U)\s+", " ")


def reference_id(reference: Column) -> Column:
    return strip(F.coalesce(F.substring_index(reference, REFERENCE_SEPARATOR, 1), F.lit("")))


def reference_note(reference: Column) -> Column:
    parts = F.split(reference, REFERENCE_SEPARATOR, 2)
    return F.coalesce(strip(F.try_element_at(parts, F.lit(2))), F.lit(""))


def truncate(text: Column, limit: int = ENTRY_CHARS, mark: str = TRUNCATION_MARK) -> Column:
    own = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(own) > limit, F.concat(rstrip(F.left(own, F.lit(limit))), F.lit(mark))).otherwise(own)


def entry_kind(number: Column) -> Column:
    own = F.lower(strip(number))
    return F.when(own.startswith("iec "), "standard").when(own.startswith("annex"), "annex").otherwise("article")


def finding_signature(category: Column, source: Column, title: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (category, source, title)])


def shell_quote(text: Column) -> Column:
    """A word of a POSIX shell command line."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(text.rlike(r"^[A-Za-z0-9@%+=:,./_-]+$"), text).otherwise(quoted)


def citations(text: Column) -> Column:
    """All citations: those of the first family in their order, then the second, and so on."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iU){p}"), F.lit(0)) for p in CITATIONS])


def _covers(longer: Column, shorter: Column) -> Column:
    following = F.substring(longer, F.length(shorter) + 1, F.lit(1))
    return (longer == shorter) | ((shorter != "") & longer.startswith(shorter) & ~following.rlike(r"^[\p{L}\p{N}]"))


def matches(citation: Column, allowed: Column) -> Column:
    """Whether one of two normalised numbers covers the other, with or without a standard's name."""
    bare = [F.regexp_replace(c, f"(?U){STANDARD_PREFIX}", "") for c in (citation, allowed)]
    return _covers(citation, allowed) | _covers(allowed, citation) | _covers(*bare) | _covers(*bare[::-1])


def boundary_prefixes(number: Column) -> Column:
    """The beginnings of a normalised number that end where no letter or digit follows, itself included."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    ends = F.filter(places, lambda i: (i >= F.length(number)) | ~F.substring(number, i + 1, F.lit(1)).rlike(r"^[\p{L}\p{N}]"))
    return F.transform(ends, lambda i: F.left(number, i))


def cover_keys(number: Column, cited: bool) -> Column:
    """Keys of which a citation and an allowed number have one in common if, and only if, ``matches`` holds.

    One number covers another if that is one of its boundary prefixes. So one side gives its prefixes and
    the other itself, each both ways, and the same without a standard's name.
    """
    bare = F.regexp_replace(number, f"(?U){STANDARD_PREFIX}", "")

    def keys(kind: str, own: Column, prefixes: bool) -> Column:
        return F.transform(boundary_prefixes(own) if prefixes else F.array(own), lambda k: F.concat(F.lit(kind), k))

    return F.concat(keys("a:", number, cited), keys("b:", number, not cited), keys("c:", bare, cited), keys("d:", bare, not cited))


def unsupported_citations(text: Column, allowed: Column) -> Column:
    """Citations in a text, each once, that no allowed number covers."""
    known = F.transform(F.filter(allowed, lambda a: F.coalesce(a, F.lit("")) != ""), normalize)
    return F.array_distinct(F.filter(citations(text), lambda c: ~F.exists(known, lambda a: matches(normalize(c), a))))


def summary_section(text: Column, label: str) -> Column:
    """The text under a label, up to the next one; of several, the last. Null if there is none."""
    any_label = "|".join(SUMMARY_LABELS)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)【{label}】(.*?)(?=【(?:{any_label})】|\z)"), F.lit(1))
    return strip(F.try_element_at(found, F.lit(-1)))


def summary(text: Column) -> Column:
    """The three sections of a summary, or null if one lacks."""
    name, reason, remedy = (summary_section(text, label) for label in SUMMARY_LABELS)
    whole = name.isNotNull() & reason.isNotNull() & remedy.isNotNull()
    return F.when(whole, F.struct(name.alias("weakness_name"), reason.alias("weakness_reason"), remedy.alias("remediation")))


def joined_lines(*parts: Column | str) -> Column:
    """The parts that are not empty, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def detail_lines(detail: Column) -> Column:
    """``- name: value`` for each field of a JSON object that is not null or empty, in its order.

    Lists and objects are shown as JSON. What is no object has no lines.
    """
    fields = F.map_entries(F.from_json(detail, "map<string,string>"))
    shown = F.filter(fields, lambda f: f["value"].isNotNull() & ~f["value"].isin("", "[]", "{}"))
    return F.coalesce(F.array_join(F.transform(shown, lambda f: F.concat(F.lit("- "), f["key"], F.lit(": "), f["value"])), "\n"), F.lit(""))
