"""Knowledge bases: weakness XML, articles and annexes of a regulation in HTML, numbered text lines."""

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.text import joined_lines
from gleaner.sources.xml_records import read_elements

# The regulation's paragraph classes, label patterns and annexes.
PARAGRAPHS = ("oj-ti-art", "oj-sti-art", "oj-normal")
PART_HEADING = "oj-ti-grseq-1"
LABEL = re.compile(r"^(\([a-zA-Z0-9ivxIVX]+\)|[0-9]+(?:\.[0-9]+)*\.)$")
PART = re.compile(r"^(Part|Class)\s+[IVXLC]+")
ANNEXES = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII")
ARTICLE = r"Article\s+(\d+)"


def embedding_text(*parts: Column) -> Column:
    """What of an entry is embedded: number, title and text, those that are not empty."""
    return joined_lines(*parts)


#: Prefixes of elements and attributes.
_PREFIX = re.compile(r"""(?:</?|\s)([A-Za-z_][\w.-]*):[A-Za-z_]""")


class Weaknesses:
    """Table function: the entries of a weakness list in XML, whatever their namespace and depth."""

    @staticmethod
    def parsed(xml: str) -> ElementTree.Element | None:
        """A document, or a slice of one whose prefixes are declared around it; None if it is neither."""
        try:
            return ElementTree.fromstring(xml)
        except ElementTree.ParseError:
            declared = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(_PREFIX.findall(xml)) - {"xml", "xmlns"}))
        try:
            return ElementTree.fromstring(f"<slice{declared}>{xml}</slice>")
        except ElementTree.ParseError:
            return None

    @staticmethod
    def text(element: ElementTree.Element | None) -> str:
        return "" if element is None else " ".join(t.strip() for t in element.itertext() if t.strip())

    def eval(self, xml: str) -> Iterator[tuple]:
        name = lambda e: e.tag.rpartition("}")[2]
        if (root := self.parsed(xml or "")) is None:
            return
        for pos, e in enumerate(x for x in root.iter() if name(x) == "Weakness"):
            child = {name(c): c for c in e}
            fixes = [self.text(next((d for d in m if name(d) == "Description"), None)) for m in child.get("Potential_Mitigations", ()) if name(m) == "Mitigation"]
            yield pos, f"CWE-{e.get('ID', '')}", e.get("Name", ""), e.get("Status", ""), self.text(child.get("Description")), self.text(child.get("Extended_Description")), [f for f in fixes if f]


WEAKNESS_SCHEMA = "pos INT, key STRING, title STRING, status STRING, text STRING, extended STRING, mitigations ARRAY<STRING>"


def weaknesses(files: DataFrame, xml: str = "xml") -> DataFrame:
    """Entries that are not deprecated and have text. Each row of ``files`` is one list, or one slice of it.

    ``read_weaknesses`` gives a slice an entry. A row that is null or no XML has no entries.
    """
    spark = files.sparkSession
    spark.udtf.register("weakness_rows", F.udtf(Weaknesses, returnType=WEAKNESS_SCHEMA))
    rows = spark.sql(f"SELECT t.* FROM {{files}} f, LATERAL weakness_rows(f.`{xml}`) t", files=files)
    rows = rows.withColumn("embedding_text", F.array_join(F.filter(F.concat(F.array("title", "text", "extended"), "mitigations"), lambda p: p != ""), "\n"))
    return rows.filter("status <> 'Deprecated' AND embedding_text <> ''")


def read_weaknesses(spark: SparkSession, path: str, tag: str = "Weakness") -> DataFrame:
    """(file, record, xml): weakness lists as one row an entry, so that a list of any size is read by many tasks.

    An entry goes to ``weaknesses`` as a slice; ``unread`` gives those that are no XML.
    """
    return read_elements(spark, path, tag)


def unread(entries: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of ``entries`` that cannot be parsed, so that none is lost unseen."""
    broken = F.udf(lambda text: text is None or Weaknesses.parsed(text) is None, "boolean")
    return entries.filter(broken(F.col(xml)))


def missing_annexes(items: DataFrame, doc: str) -> DataFrame:
    """(doc, annex): annexes of which a document has no item."""
    wanted = F.explode(F.array(*[F.lit(f"Annex {roman}") for roman in ANNEXES])).alias("annex")
    found = items.select(doc, F.regexp_extract("article_no", r"^(Annex [IVX]+)", 1).alias("annex")).distinct()
    return items.select(doc).distinct().select(doc, wanted).join(found, [doc, "annex"], "left_anti")


class _Node:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def find(self, tag: str, deep: bool = True) -> Iterator["_Node"]:
        for c in self.children:
            if isinstance(c, _Node):
                if c.tag == tag:
                    yield c
                if deep:
                    yield from c.find(tag)

    def text(self, joint: str = " ") -> str:
        parts = [c.text(joint) if isinstance(c, _Node) else c.strip() for c in self.children]
        return joint.join(p for p in parts if p)

    def has(self, kind: str) -> bool:
        return kind in self.attributes.get("class", "").split()


class _Tree(HTMLParser):
    """A small tree of a page, enough to walk tables and paragraphs."""

    VOID = frozenset("area base br col hr img input link meta wbr".split())

    def __init__(self, page: str):
        super().__init__()
        self.root = _Node("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class Paragraphs:
    """Table function: the regulation's paragraphs outside of annexes, in order."""

    def eval(self, page: str) -> Iterator[tuple]:
        n = 0
        stack = [_Tree(page or "").root]
        while stack:
            node = stack.pop()
            if node.tag == "div" and node.attributes.get("id", "").startswith("anx_"):
                continue
            kind = next((k for k in PARAGRAPHS if node.has(k)), None) if node.tag == "p" else None
            if kind and node.text():
                yield n, kind, node.text()
                n += 1
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]


def articles(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, article_no, title, text): a title paragraph opens an article; its first subtitle names it."""
    spark = pages.sparkSession
    spark.udtf.register("article_paragraphs", F.udtf(Paragraphs, returnType="n INT, kind STRING, text STRING"))
    rows = spark.sql(f"SELECT p.`{doc}`, t.* FROM {{pages}} p, LATERAL article_paragraphs(p.`{page}`) t", pages=pages)
    return article_rows(rows, doc)


def article_rows(rows: DataFrame, doc: str) -> DataFrame:
    """Segmentation of (doc, n, kind, text) rows into articles."""
    opens = (F.col("kind") == PARAGRAPHS[0]) & (F.regexp_extract("text", ARTICLE, 1) != "")
    rows = rows.withColumn("opens", opens).filter((F.col("kind") != PARAGRAPHS[0]) | F.col("opens"))
    rows = rows.withColumn("article", F.sum(F.col("opens").cast("int")).over(Window.partitionBy(doc).orderBy("n"))).filter("article > 0")
    within = Window.partitionBy(doc, "article")
    rows = rows.withColumn("name_at", F.min(F.when(F.col("kind") == PARAGRAPHS[1], F.col("n"))).over(within))
    is_name = F.col("n") == F.col("name_at")
    text = F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens") & ~F.coalesce(is_name, F.lit(False)), F.struct("n", "text")))), lambda x: x["text"])
    grouped = rows.groupBy(doc, "article").agg(F.max(F.when(F.col("opens"), F.regexp_extract("text", ARTICLE, 1))).alias("no"), F.coalesce(F.max(F.when(is_name, F.col("text"))), F.lit("")).alias("title"), F.array_join(text, "\n").alias("text"))
    return grouped.select(doc, F.concat(F.lit("Article "), "no").alias("article_no"), "title", "text")


def split_articles(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """The fallback without markup: a text cut before each article number."""
    parts = rows.select(doc, F.posexplode(F.split(text, r"(?=Article\s+\d)")).alias("n", "part")).filter(F.col("part").rlike(rf"^{ARTICLE}"))
    return parts.select(doc, "n", F.concat(F.lit("Article "), F.regexp_extract("part", ARTICLE, 1)).alias("article_no"), F.regexp_replace("part", r"(?U)^\s+|\s+$", "").alias("text"))


def labelled_rows(table: _Node) -> Iterator[tuple[list[str], str]]:
    """(labels, text) of a table's first row and of those of the tables in it, outermost label first.

    A label is the first cell that looks like one, and what it labels is the cell behind it.
    """
    waiting: list[tuple[_Node, list[str]]] = [(table, [])]
    while waiting:
        inner, above = waiting.pop()
        cells = [c for row in list(inner.find("tr"))[:1] for c in row.find("td", deep=False)]
        labels = [c.text("") for c in cells]
        place = next((k for k, label in enumerate(labels[:-1]) if LABEL.match(label)), None)
        # A label in the last cell labels nothing, and no later one counts.
        if place is None:
            continue
        path, body = [*above, labels[place]], cells[place + 1]
        pieces = [c.text() for c in body.children if isinstance(c, _Node) and (c.tag == "span" or c.tag == "p" and c.has("oj-normal"))]
        yield path, " ".join(filter(None, pieces))
        waiting += [(t, path) for t in reversed(list(body.find("table", deep=False)))]


class AnnexItems:
    """Table function: the items of all annexes of a page."""

    def eval(self, page: str) -> Iterator[tuple]:
        root, n = _Tree(page or "").root, 0
        everything = [root]
        for node in everything:
            everything += [c for c in node.children if isinstance(c, _Node)]
        by_id = {}
        for node in everything:
            by_id.setdefault(node.attributes.get("id"), node)
        for roman in ANNEXES:
            if (annex := by_id.get(f"anx_{roman}")) is None:
                continue
            for item in self.listed(annex, roman) if roman == "IV" else self.tables(annex, roman):
                yield n, *item
                n += 1

    @staticmethod
    def tables(annex: _Node, roman: str) -> Iterator[tuple[str, str, str]]:
        part, plain = "", 0
        for child in annex.children:
            if not isinstance(child, _Node):
                continue
            if child.tag == "p" and child.has(PART_HEADING):
                part, plain = child.text(), 0
            elif child.tag == "table":
                items = [("".join(path), text) for path, text in labelled_rows(child) if text]
                if not items:
                    plain += 1
                    items = [(str(plain), child.text())] if child.text() else []
                named = PART.match(part)
                for label, text in items:
                    yield f"Annex {roman} {named[0] + ' ' if named else ''}{label}", part, text

    @staticmethod
    def listed(annex: _Node, roman: str) -> Iterator[tuple[str, str, str]]:
        for block in annex.find("div", deep=False):
            paragraphs = list(block.find("p", deep=False)) if block.has("oj-enumeration-spacing") else []
            number = re.match(r"[0-9]+", paragraphs[0].text("")) if paragraphs else None
            text = " ".join(p.text() for p in paragraphs[1:]).strip()
            if number and text:
                yield f"Annex {roman} ({number[0]})", "", text


def annexes(pages: DataFrame, doc: str, page: str) -> DataFrame:
    spark = pages.sparkSession
    spark.udtf.register("annex_rows", F.udtf(AnnexItems, returnType="n INT, article_no STRING, title STRING, text STRING"))
    return spark.sql(f"SELECT p.`{doc}`, t.* FROM {{pages}} p, LATERAL annex_rows(p.`{page}`) t", pages=pages)


def regulation(pages: DataFrame, doc: str, page: str, plain: str) -> DataFrame:
    """Articles by markup, or by number in pages where no markup was found, and the annexes' items."""
    marked = articles(pages, doc, page)
    missed = pages.join(marked.select(doc).distinct(), doc, "left_anti")
    split = split_articles(missed, doc, plain).select(doc, "article_no", F.lit("").alias("title"), "text")
    return marked.unionByName(split).unionByName(annexes(pages, doc, page).select(doc, "article_no", "title", "text"))


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of JSON arrays."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_entries(entries: DataFrame, path: str) -> None:
    """The store that retrieval reads: a folder a knowledge base, so that a query for one reads only it."""
    entries.write.mode("overwrite").partitionBy("kb").parquet(path)
