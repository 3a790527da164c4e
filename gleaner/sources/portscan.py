"""Port-scan XML: open ports, and vulnerabilities that scan scripts found."""

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scoring
from gleaner.functions.text import strip

HOST_SCHEMA = """
    address ARRAY<STRUCT<_addr STRING>>,
    ports STRUCT<port ARRAY<STRUCT<_protocol STRING, _portid STRING, state STRUCT<_state STRING>, service STRUCT<_name STRING, _product STRING, _version STRING>>>>
"""
# The pattern of vulnerability numbers and the map of risk factors.
NUMBER = r"(?i:CVE-\d{4}-\d{4,})"
RISK_FACTORS = ("critical", "high", "medium", "low")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "host").schema(HOST_SCHEMA).load(path)


def parse_hosts(rows: DataFrame, xml: str) -> DataFrame:
    """``rows`` with the parsed host of an XML text column."""
    return rows.withColumn("host", F.from_xml(F.col(xml), F.lit(HOST_SCHEMA))).select("*", "host.*").drop("host")


def open_ports(hosts: DataFrame) -> DataFrame:
    """One row an open port of a host's first address: target, protocol, port, service, product, version, title.

    Other columns of ``hosts`` stay.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = F.try_element_at("address", F.lit(1))["_addr"]
    each = hosts.withColumn("target", first).filter("target IS NOT NULL").select("*", F.posexplode("ports.port").alias("port_no", "p")).filter("p.state._state = 'open'")
    product = F.concat(F.lit(" ("), text("p.service._product"), F.lit(" "), text("p.service._version"), F.lit(")"))
    known = (text("p.service._product") != "") | (text("p.service._version") != "")
    plain = F.trim(F.concat(text("p._protocol"), F.lit("/"), text("p._portid"), F.lit(" "), text("p.service._name")))
    title = F.replace(F.replace(F.concat(plain, F.when(known, product).otherwise("")), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    more = [c for c in hosts.columns if c not in ("address", "ports", "target", "port", "title")]
    return each.select(*more, "target", "port_no", text("p._protocol").alias("protocol"), text("p._portid").alias("port"), text("p.service._name").alias("service"), text("p.service._product").alias("product"), text("p.service._version").alias("version"), title.alias("title"))


class ScriptTables:
    """Table function: every table of all scripts of a host's XML, in order, with its elements as a flat list.

    An element's place is ``own``, or the key of the table in the table that it stands in.
    """

    PLACES = ("ids", "scores")

    def eval(self, xml: str) -> Iterator[tuple]:
        try:
            host = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return
        address = host.find("address")
        if address is None:
            return
        scripts = [(None, s) for s in host.iterfind("hostscript/script")]
        scripts += [(f"{p.get('protocol', '')}/{p.get('portid', '')}", s) for p in host.iterfind("ports/port") for s in p.iterfind("script")]
        everything = [(port, script, table) for port, script in scripts for table in script.iter("table")]
        for n, (port, script, table) in enumerate(everything):
            inner = [(place, table.find(f"table[@key='{place}']")) for place in self.PLACES]
            items = [(place, e.get("key"), e.text) for place, part in [("own", table), *inner] if part is not None for e in part.iterfind("elem")]
            yield address.get("addr", ""), port, script.get("id", ""), n, table.get("key"), items


TABLES = "target STRING, port STRING, script_id STRING, n INT, table_key STRING, items ARRAY<STRUCT<place: STRING, key: STRING, value: STRING>>"


def _named(key: str) -> Column:
    """The trimmed value of a table's own element with a key; of several the last, and blank without one."""
    found = F.filter("items", lambda x: (x["place"] == "own") & (x["key"] == key))
    return F.coalesce(strip(F.try_element_at(found, F.lit(-1))["value"]), F.lit(""))


def _values(place: str, bare: bool = False) -> Column:
    """Values of the elements at a place; ``bare`` are those without a key."""
    found = F.filter("items", lambda x: (x["place"] == place) & (x["key"].isNull() if bare else F.lit(True)))
    return F.transform(found, lambda x: F.coalesce(x["value"], F.lit("")))


def numbers() -> Column:
    """A table's vulnerability numbers, each once: its key, then its own elements without a key, then its list of numbers."""
    key = F.coalesce(F.regexp_extract("table_key", f"^{NUMBER}$", 0), F.lit(""))
    listed = F.transform(F.concat(_values("own", bare=True), _values("ids")), lambda v: F.regexp_extract(v, NUMBER, 0))
    return F.array_distinct(F.transform(F.filter(F.concat(F.array(key), listed), lambda v: v != ""), F.upper))


def script_findings(hosts: DataFrame, xml: str) -> DataFrame:
    """One row a vulnerability, with its severity and title."""
    spark = hosts.sparkSession
    spark.udtf.register("script_tables", F.udtf(ScriptTables, returnType=TABLES))
    tables = spark.sql(f"SELECT h.* EXCEPT (`{xml}`), t.* FROM {{hosts}} h, LATERAL script_tables(h.`{xml}`) t", hosts=hosts)
    rows = tables.withColumn("state", _named("state")).filter(scoring.is_vulnerable_state(F.col("state")))
    rows = rows.withColumns({"cve_ids": numbers(), "cvss_score": F.array_max(F.transform(_values("scores"), scoring.parse_score))})
    level = severity(F.col("cvss_score"), F.lower(F.trim(_named("risk_factor"))), F.col("state"))
    return rows.withColumns({"severity": level, "title": title(_named("title"), F.col("cve_ids"), F.col("script_id"), F.col("port"))}).drop("items", "table_key")


def severity(score: Column, factor: Column, state: Column) -> Column:
    by_state = F.when(state.contains("(Exploitable)"), F.lit("critical")).when(state.contains("(DoS)"), F.lit("high")).otherwise(F.lit("medium"))
    return F.coalesce(scoring.score_to_severity(score), F.when(factor.isin(*RISK_FACTORS), factor), by_state)


def title(own: Column, numbers: Column, script: Column, port: Column) -> Column:
    name = F.coalesce(F.nullif(own, F.lit("")), F.when(F.size(numbers) > 0, F.array_join(numbers, ", ")), script)
    return F.when(F.coalesce(port, F.lit("")) == "", name).otherwise(F.concat(name, F.lit("（"), port, F.lit("）")))
