"""Chat formatting by schema fingerprints.

A record is JSON text in one of several layouts. The hash of its nested field paths (array items are
one path) selects a declarative mapping, which turns the record into canonical turns: id, turn, role,
text. Layouts that are alike but for optional fields are listed under each of their fingerprints.
Fields that say something about a record or a turn, such as metadata or a name, are left out of the
hash, and a content in parts ({"type": "text", "text": ...}) counts as a content.

Turns are formatted one by one with a template that marks them; control strings inside a text or
role are broken by an escape that can be undone. A conversation's formatted text is that of its turns
in order, so one of any length is read and checked as a stream.

Defined cases: a record that is no JSON object, is nested too deeply to be read, has no known
fingerprint (a list of bare values where turns should be has another than a list of turns), or has a
turn number that is none or a text that is no Unicode gives one row with the layout null, no role, and
the record as it is for a text, so that nothing is lost; null roles and texts are empty; equal turns of a
conversation are kept and come in order of turn and formatted turn; rows with a null id are one
conversation; very long texts and conversations are taken whole; an empty table gives no rows; input
columns named segment or learned are kept, and the added ones get underscores before their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import free_name

#: Names of roles in foreign layouts and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: paths of the fields and where each turn comes from.

    ``each`` names a list whose items are turns with the fields ``role`` and ``text``; otherwise
    ``turns`` lists (role, fields joined by a blank line) of the record itself, and ``role``, if
    given, makes the record one turn. ``optional`` fields may lack. ``roles`` renames roles.
    """

    name: str
    fields: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turn: str = ""
    optional: tuple[str, ...] = field(default=())
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), each="messages", role="role", text="content", optional=("id",)),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", optional=("id", "system"), roles=ROLES),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].utterance"), each="dialogue", role="speaker", text="utterance", optional=("id",), roles=ROLES),
    Layout("instruction", ("instruction", "output"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input", "system", "id")),
    Layout("prompt", ("prompt", "response"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system", "id")),
    Layout("completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",))), optional=("id",)),
    Layout("question", ("question", "answer"), turns=(("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("context", "id")),
    Layout("turn", ("role", "text", "turn"), role="role", text="text", turn="turn"),
)


#: Fields that no mapping reads, with all that is below them: of a record, and of the turns of a list.
SIDE_FIELDS = frozenset("category conversation_id created dataset lang language license meta metadata model quality rating score source split tags task timestamp tokens url version".split())
SIDE_OF_TURN = frozenset("created id index lang language meta metadata model name rank rating score timestamp token_count tokens weight".split())


def core(value: dict) -> dict:
    """A record without its side fields, its contents of parts as texts.

    A turn of two fields has no side fields, and parts are taken if all of them are texts: an image or
    a call of a tool is no side field, so that record has no layout.
    """
    found = {}
    for name, item in value.items():
        if name in SIDE_FIELDS:
            continue
        if isinstance(item, list) and item and all(isinstance(x, dict) for x in item):
            item = [{k: _joined(v) for k, v in x.items() if k not in SIDE_OF_TURN or len(x) <= 2} for x in item]
        found[name] = item
    return found


def _joined(content: object) -> object:
    """The texts of a content in parts, one after the other; any other content as it is."""
    if not isinstance(content, list) or not content:
        return content
    texts = []
    for part in content:
        if isinstance(part, str):
            texts.append(part)
        elif isinstance(part, dict) and isinstance(part.get("text"), str):
            texts.append(part["text"])
        else:
            return content
    return "".join(texts)


def paths(value: object) -> set[str]:
    """Paths of all fields that hold no further fields.

    An empty object or list is told from a bare value, and dots and brackets in a field's name from
    those of a path.
    """
    found, waiting = set(), [(value, None)]
    while waiting:
        item, at = waiting.pop()
        if isinstance(item, dict) and item:
            names = [(v, re.sub(r"[.\\\[\]{}]", r"\\\g<0>", k)) for k, v in item.items()]
            waiting += [(v, k if at is None else f"{at}.{k}") for v, k in names]
        elif isinstance(item, list) and item:
            waiting += [(v, f"{at or ''}[]") for v in item]
        else:
            found.add((at or "") + ("{}" if isinstance(item, dict) else "[0]" if isinstance(item, list) else ""))
    return found


def fingerprint(found: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Every fingerprint of every layout."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for bits in range(1 << len(layout.optional)):
            extra = {f for k, f in enumerate(layout.optional) if bits >> k & 1}
            out.setdefault(fingerprint({*layout.fields, *extra}), layout)
        if layout.each:
            out.setdefault(fingerprint({f"{layout.each}[0]"}), layout)
    return out


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: str | None, known: dict[str, Layout]) -> list[tuple[int | None, str, str, str]] | None:
    """(turn, role, text, layout) of a record; None if its layout is not known or it holds what a table cannot."""
    try:
        value = json.loads(record or "")
        layout = known.get(fingerprint(paths(value))) if isinstance(value, dict) else None
        if layout is None and isinstance(value, dict):
            value = core(value)
            layout = known.get(fingerprint(paths(value)))
        found = None if layout is None else _mapped(value, layout)
        for turn, role, text, _ in found or []:
            if not (turn is None or (type(turn) is int and -(1 << 63) <= turn < 1 << 63)):
                return None
            (role + text).encode()
    except (ValueError, RecursionError):  # no JSON, lone surrogates, or nested too deeply
        return None
    return found


def _mapped(value: dict, layout: Layout) -> list[tuple[object, str, str, str]]:
    role_of = lambda role: layout.roles.get(_text(role), _text(role))
    if layout.each:
        pairs = [("system", value["system"])] if value.get("system") is not None else []
        pairs += [(i.get(layout.role), i.get(layout.text)) for i in value[layout.each]]
        return [(k, role_of(r), _text(t), layout.name) for k, (r, t) in enumerate(pairs)]
    if layout.turns:
        pairs = [(role, "\n\n".join(_text(value[f]) for f in fields if value.get(f) not in (None, ""))) for role, fields in layout.turns if role != "system" or value.get(fields[0]) not in (None, "")]
        return [(k, r, t, layout.name) for k, (r, t) in enumerate(pairs)]
    return [(value[layout.turn], role_of(value[layout.role]), _text(value[layout.text]), layout.name)]


def canonical_turns(records: DataFrame, id_column: str = "conv_id", record_column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """id, turn, role, text and layout of every turn of every record."""
    known = registry(layouts)
    id_type = records.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for k, record in enumerate(batch.column(1)):
                found = turns_of(record.as_py(), known)
                own = [(None, None, record.as_py(), None)] if found is None else found
                row += [k] * len(own)
                out += own
            columns = [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], ["id", "turn", "role", "text", "layout"])

    rows = records.select(F.col(id_column).alias("id"), F.col(record_column).cast("string").alias("record"))
    return rows.mapInArrow(run, f"id {id_type}, turn long, role string, text string, layout string").withColumnRenamed("id", id_column)


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    #: Strings that no text may hold as they are: the template's own, and those of other templates.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>")
    learn: tuple[str, ...] = ("assistant",)

    def escape(self, text: F.Column) -> F.Column:
        """Backslashes are doubled, and each control string gets a backslash and an e behind its first character."""
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        start = "|".join(re.escape(c) for c in self.control)
        return F.regexp_replace(doubled, rf"(?=(?:{start}))(.)", r"$1\\e")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\|e|n)", lambda m: {"\\": "\\", "e": "", "n": "\n"}[m[1]], text)

    def read(self, segment: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        if not segment.startswith(self.begin) or not segment.endswith(self.end):
            raise ValueError("not a formatted turn")
        role, _, text = segment[len(self.begin) : len(segment) - len(self.end)].partition(self.middle)
        return self.unescape(role), self.unescape(text)


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """``turns`` with ``segment``, the formatted turn, and ``learned``, whether its text is under the loss mask."""
    role = F.replace(template.escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    segment = F.concat(F.lit(template.begin), role, F.lit(template.middle), template.escape(F.coalesce("text", F.lit(""))), F.lit(template.end))
    names = free_name(turns, "segment", "learned")
    return turns.withColumn(names[0], segment).withColumn(names[1], F.coalesce(F.col("role").isin(*template.learn), F.lit(False)))


def read_back(formatted: DataFrame, id_column: str = "conv_id", template: Template = Template(), segment_column: str = "segment") -> DataFrame:  # noqa: B008
    """Counts and digests of each conversation, from its formatted turns alone.

    Rows of a conversation come to one task in order and are taken one after the other, so a
    conversation of any length needs no more memory than its longest turn.
    """
    id_type = formatted.schema[id_column].dataType.simpleString()
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_, n = None, False, [0, 0, 0]
        turns, loss = hashlib.sha256(), hashlib.sha256()
        schema = None
        for batch in batches:
            schema, out = batch.schema.field(0).type, []
            for ident, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not open_ or ident != current:
                    if open_:
                        out.append((current, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2]))
                    current, open_, n = ident, True, [0, 0, 0]
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text = template.read(segment)
                n[0] += 1
                n[2] += len(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if role in template.learn:
                    n[1] += len(text)
                    loss.update(text.encode())
            yield _batch(out, schema, names)
        if open_:
            yield _batch([(current, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2])], schema, names)

    rows = formatted.select(F.col(id_column).alias("id"), F.col(segment_column).alias("segment"), "turn")
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "segment").select("id", "segment")
    schema = f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _batch(rows: list[tuple], id_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
