"""Classification of findings: rule table, then known vulnerabilities, then review."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scoring

# Services, risk levels and clauses of the rule table.
RULES = (
    ("telnet", "high", "CRA Annex I Part I(2)(e)", "IEC 62443-4-2 CR 4.1"),
    ("ftp", "high", "CRA Annex I Part I(2)(e)", "IEC 62443-4-2 CR 4.1"),
    ("http", "medium", "CRA Annex I Part I(2)(e)", "IEC 62443-4-2 CR 4.1"),
    ("snmp", "medium", "CRA Annex I Part I(2)(b)", "IEC 62443-4-2 CR 1.5"),
    ("rtsp", "medium", "CRA Annex I Part I(2)(d)", "IEC 62443-4-2 CR 1.1"),
    ("upnp", "low", "CRA Annex I Part I(2)(j)", "IEC 62443-4-2 CR 7.7"),
)
KNOWN_CRA, KNOWN_IEC = "CRA Annex I Part II(1)", "IEC 62443-4-2 CR 3.10"

#: Why each service of the rule table is a weakness, and what to do; this project's own wording.
RULE_TEXTS = {
    "telnet": ("Telnet sends passwords and commands in the clear, so anyone on the path can read them.", "Turn Telnet off and administer the device over SSH."),
    "ftp": ("FTP sends passwords and files in the clear, so they can be read or changed on the way.", "Turn FTP off and move files over SFTP or FTPS."),
    "http": ("Plain HTTP protects neither the secrecy nor the integrity of logins and content.", "Serve the pages over HTTPS only and redirect or close the plain port."),
    "snmp": ("SNMP up to version 2c is guarded by a community string, which is often the factory one, and is not encrypted.", "Turn SNMP off or use version 3 with authentication and encryption."),
    "rtsp": ("RTSP streams are often open to whoever can reach the port.", "Require a login for the stream and check who may reach it."),
    "upnp": ("UPnP lets devices open ports to the outside without anyone's review.", "Turn UPnP off where it is not needed, and never offer it to the outside."),
}
#: What is said of known vulnerabilities, before and behind their numbers.
KNOWN_REASON = ("The running version has published vulnerabilities: ", ".")
KNOWN_ADVICE = ("Update to a version without ", ", or apply the vendor's mitigation, and check what was affected.")


def rule_table(spark: SparkSession) -> DataFrame:
    columns = zip(*[(*rule, *RULE_TEXTS[rule[0]]) for rule in RULES], strict=True)
    names = ["rule_service", "rule_risk", "rule_cra", "rule_iec", "rule_reason", "rule_advice"]
    # From Arrow, so that no executor starts Python workers to unpickle rows, beside those of a search.
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names))


def with_rule(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Findings with the rule for their service, if there is one. The rule table is a constant of six rows."""
    rules = rule_table(findings.sparkSession) if rules is None else rules
    return findings.join(F.broadcast(rules), F.lower(F.trim("service")) == F.col("rule_service"), "left")


def classify(findings: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Adds status, method, risk_level, reason, recommendation and the clauses.

    ``findings`` has service, cve_ids, severity and alert_risk. A rule decides first, then known
    vulnerabilities; what is left needs review and has a fallback risk.
    """
    known = F.coalesce(F.size("cve_ids") > 0, F.lit(False))
    ruled = F.col("rule_service").isNotNull()

    def pick(by_rule: Column | str, by_known: Column, otherwise: Column) -> Column:
        return F.when(ruled, by_rule if isinstance(by_rule, Column) else F.col(by_rule)).when(known, by_known).otherwise(otherwise)

    none = F.lit(None).cast("string")
    around = lambda ends: F.concat(F.lit(ends[0]), F.array_join("cve_ids", "、"), F.lit(ends[1]))
    severity = F.when(F.col("severity").isin(*scoring.LEVELS[:4]), F.col("severity")).otherwise("medium")
    out = with_rule(findings, rules).withColumns(
        {
            "status": F.when(ruled | known, "matched").otherwise("needs_review"),
            "method": pick(F.lit("rule"), F.lit("known"), F.lit("review")),
            "risk_level": pick("rule_risk", severity, scoring.fallback_risk(F.col("severity"), F.col("alert_risk"))),
            "cra_reference": pick("rule_cra", F.lit(KNOWN_CRA), none),
            "iec_reference": pick("rule_iec", F.lit(KNOWN_IEC), none),
            "known_list": F.when(~ruled & known, F.array_join("cve_ids", "、")),
            "weakness_reason": pick("rule_reason", around(KNOWN_REASON), none),
            "recommendation": pick("rule_advice", around(KNOWN_ADVICE), none),
        }
    )
    return out.drop("rule_service", "rule_risk", "rule_cra", "rule_iec", "rule_reason", "rule_advice")


def finalize(classified: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds recommendation_source and weakness_name; ``texts`` (finding_id, remediation, weakness_name) has what was generated.

    A generated remediation takes the place of a matched finding's rule text. Findings to review keep
    theirs empty.
    """
    matched = F.col("status") == "matched"
    if texts is None:
        rows = classified.withColumns({"remediation": F.lit(None).cast("string"), "weakness_name": F.lit(None).cast("string")})
    else:
        rows = classified.join(texts.select("finding_id", "remediation", "weakness_name"), "finding_id", "left")
    made = matched & (F.coalesce("remediation", F.lit("")) != "")
    source = F.when(made, "llm").when(matched, "rule")
    return rows.withColumns({"recommendation_source": source, "recommendation": F.when(made, F.col("remediation")).otherwise(F.col("recommendation")), "weakness_name": F.when(matched, F.col("weakness_name"))}).drop("remediation")


def retrieval_text(category: Column, service: Column, title: Column, product: Column, version: Column) -> Column:
    """The text with which a finding is looked up: service, product and version for networks, else the title."""
    name = F.coalesce(F.nullif(service, F.lit("")), title)
    network = F.concat_ws(" ", F.concat(name, F.lit(" service")), F.nullif(product, F.lit("")), F.nullif(version, F.lit("")))
    return F.when(category == "network", network).otherwise(title)
