"""Elements of one name in XML files of any size, read by many tasks.

Files are read as rows that end at '>', so a split begins behind one. Whether a row there is in a
comment, in a CDATA section, in a quoted value or in the middle of an element depends on all rows
before it. So each split first tells, for every state that it may begin in, the state in which it ends
and how many elements begin in it. These steps are composed in the order of a file's splits, a row a
split. Then every split knows where it begins, gives its elements, and only those that lie across
splits are put together.

The name counts whatever its prefix; white space of any kind, '/' or '>' ends it. Elements of that name
inside one another are not told apart. A file that ends within an element gives it as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.storage import keep

#: States of a row's beginning: plain, in a comment, a CDATA section, an instruction, or behind an open quote of another tag or of the element's own.
PLAIN, COMMENT, DATA, INSTRUCTION, DOUBLE, SINGLE, OWN_DOUBLE, OWN_SINGLE = range(8)
#: Added to a state inside an element.
INSIDE = 8
STATES = 16
_QUOTED = re.compile(r"""(?:[^"']|"[^"]*"|'[^']*')*""")


def stepper(tag: str) -> Callable[[int, str], tuple[int, int, bool]]:
    """The step of a row: (state, row without its '>') gives the next state, where an element begins in the row (-1: nowhere) and if one ends with it."""
    begins = re.compile(rf"<(?:[^\s<>/:\"'!?]+:)?{re.escape(tag)}(?=[\s/]|\Z)")
    ends = re.compile(rf"</(?:[^\s<>/:\"'!?]+:)?{re.escape(tag)}\s*\Z")

    def of_tag(text: str, at: int, inside: int, own: bool, begin: int) -> tuple[int, int, bool]:
        """A tag from ``at`` on, which is outside of quotes there."""
        rest = _QUOTED.match(text, at).end()
        if rest < len(text):
            quote = (OWN_DOUBLE if own else DOUBLE) if text[rest] == '"' else (OWN_SINGLE if own else SINGLE)
            return quote + inside, begin, False
        if own and text.endswith("/"):
            return PLAIN, begin, True
        return PLAIN + (INSIDE if own else inside), begin, False

    def step(state: int, text: str) -> tuple[int, int, bool]:
        inside, lexical = state & INSIDE, state & 7
        if lexical == PLAIN:
            at = text.find("<")
            if at < 0:
                return state, -1, False
            if text.startswith("<!--", at):
                return (PLAIN if text.endswith("--") and len(text) - at >= 6 else COMMENT) + inside, -1, False
            if text.startswith("<![CDATA[", at):
                return (PLAIN if text.endswith("]]") and len(text) - at >= 11 else DATA) + inside, -1, False
            if text.startswith("<?", at):
                return (PLAIN if text.endswith("?") and len(text) - at >= 3 else INSTRUCTION) + inside, -1, False
            if inside and ends.match(text, at):
                return PLAIN, -1, True
            if not inside and begins.match(text, at):
                # Until its tag is complete the element counts as begun.
                return of_tag(text, at, INSIDE, True, at)
            return of_tag(text, at, inside, False, -1)
        if lexical in (COMMENT, DATA, INSTRUCTION):
            over = text.endswith({COMMENT: "--", DATA: "]]", INSTRUCTION: "?"}[lexical])
            return (PLAIN if over else lexical) + inside, -1, False
        at = text.find('"' if lexical in (DOUBLE, OWN_DOUBLE) else "'")
        if at < 0:
            return state, -1, False
        return of_tag(text, at + 1, inside, lexical in (OWN_DOUBLE, OWN_SINGLE), -1)

    return step


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Rows of a task in runs of one split each; a split may come in several runs."""
    for batch in batches:
        files, blocks, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        begin = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[begin] or blocks[i] != blocks[begin]:
                yield files[begin], blocks[begin], values[begin:i]
                begin = i


def _summaries(batches: Iterator[pa.RecordBatch], tag: str) -> Iterator[pa.RecordBatch]:
    step, place, now, counts = stepper(tag), None, {}, []

    def told() -> pa.RecordBatch:
        end = [0] * STATES
        for state, starts in now.items():
            for s in starts:
                end[s] = state
        return pa.RecordBatch.from_arrays([pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([end], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))], ["file", "block", "ends", "begun"])

    for file, block, rows in _pieces(batches):
        if place != (file, block):
            if place is not None:
                yield told()
            # Starts that have come to the same state go on as one.
            place, now, counts = (file, block), {s: [s] for s in range(STATES)}, [0] * STATES
        for text in rows:
            after: dict[int, list[int]] = {}
            for state, starts in now.items():
                to, begin, _ = step(state, text)
                if begin >= 0:
                    for s in starts:
                        counts[s] += 1
                after.setdefault(to, []).extend(starts)
            now = after
    if place is not None:
        yield told()


def compose(summaries: DataFrame) -> DataFrame:
    """(file, block, state, before): how each split begins, and how many elements begin before it in its file."""

    def run(frame):
        frame = frame.sort_values("block")
        states, before, state, count = [], [], PLAIN, 0
        for ends, begun in zip(frame["ends"], frame["begun"], strict=True):
            states.append(state)
            before.append(count)
            state, count = int(ends[state]), count + int(begun[state])
        return frame[["file", "block"]].assign(state=states, before=before)

    return summaries.groupBy("file").applyInPandas(run, "file string, block long, state int, before long")


def _records(batches: Iterator[pa.RecordBatch], tag: str, begins: dict[tuple[str, int], tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    step, place, state, number, held = stepper(tag), None, PLAIN, 0, []
    out: list[tuple[str, int, int, str, bool]] = []
    first = True  # the element that is open began in this split

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "record", "block", "xml", "whole"])
        out.clear()
        return batch

    for file, block, rows in _pieces(batches):
        if place != (file, block):
            if held:
                out.append((*place_row(place, number), "".join(held), False))
            place, held = (file, block), []
            state, before = begins[place]
            number, first = before, not state & INSIDE
        for text in rows:
            inside = state & INSIDE
            state, begin, end = step(state, text)
            if begin >= 0:
                number, first = number + 1, True
                held = [text[begin:] + ">"]
            elif inside:
                held.append(text + ">")
            if end:
                out.append((*place_row(place, number), "".join(held), first))
                held, first = [], True
        if len(out) >= 500:
            yield flush()
    if held:
        out.append((*place_row(place, number), "".join(held), False))
    if out:
        yield flush()


def place_row(place: tuple[str, int], number: int) -> tuple[str, int, int]:
    return place[0], number, place[1]


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, record, xml): every element of that name, numbered from 1 in its file.

    The states of splits go to all tasks: some 100 bytes for each split of the input.
    """
    rows = spark.read.format("text").option("lineSep", ">").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    summed = keep(rows.mapInArrow(lambda batches: _summaries(batches, tag), "file string, block long, ends array<int>, begun array<long>"))
    begins = {(r["file"], r["block"]): (r["state"], r["before"]) for r in compose(summed).toLocalIterator()}
    held = spark.sparkContext.broadcast(begins)
    # Written at once, as another size of splits would have other states.
    parts = keep(rows.mapInArrow(lambda batches: _records(batches, tag, held.value), "file string, record long, block long, xml string, whole boolean"))
    across = parts.filter("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "xml"))), lambda x: x["xml"]), "").alias("xml"))
    return parts.filter("whole").select("file", "record", "xml").unionByName(across)
