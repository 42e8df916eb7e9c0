"""Chat formatting: schema fingerprints pick declarative mappings into canonical turns; turns are
rendered with a template whose control strings are escaped reversibly, and parsed back.

Template, a turn:  `### ` role `: ` text ` </turn>` line end.  In roles and texts a backslash goes in
front of each backslash, `###` and `</turn>` (in roles of each `:` too), so the first bare `</turn>`
ends a turn.  The loss mask is a list of code-point spans that cover the assistants' escaped texts."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

# --------------------------------------------------------------------------- layouts


def paths(value, at: str = "") -> set[str]:
    """Paths of all fields of a JSON value; `[]` stands for every element of a list."""
    if isinstance(value, dict):
        return set().union({at} if not value else set(), *(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(fields) -> str:
    """Hash of a set of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


#: Layouts: their fields, and the turns as (role, path) in order, or a list with role and text keys.
#: Optional fields may be missing or present; each such choice has a fingerprint of its own.  Only layouts
#: with `roles` rename roles; all others keep them as they are.
LAYOUTS = [
    {"name": "turn row", "fields": ["turn", "role", "text"], "row": ("role", "text", "turn")},
    {"name": "messages", "fields": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    {"name": "role-text list", "fields": ["turns[].role", "turns[].text"], "list": ("turns", "role", "text")},
    {"name": "from-value", "fields": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value"), "roles": True},
    {"name": "prompt", "fields": ["prompt", "completion"], "optional": ["system"], "turns": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
    {"name": "question", "fields": ["question", "answer"], "optional": ["system"], "turns": [("system", "system"), ("user", "question"), ("assistant", "answer")]},
    {"name": "instruction", "fields": ["instruction", "output"], "optional": ["system", "input"], "turns": [("system", "system"), ("user", ["instruction", "input"]), ("assistant", "output")]},
]
#: Fingerprints that a task remembers.
MAX_PRINTS = 1 << 16
#: Names of roles in other layouts (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}


def mappings(layouts=None) -> dict[str, dict]:
    """Fingerprint -> layout, for every choice of a layout's optional fields."""
    out = {}
    for lay in LAYOUTS if layouts is None else layouts:
        extra = lay.get("optional", [])
        for k in range(1 << len(extra)):
            out[fingerprint(lay["fields"] + [f for j, f in enumerate(extra) if k >> j & 1])] = lay
    return out


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _role(v, rename: bool = False) -> str:
    r = _text(v)
    return ROLES.get(r.strip().lower(), r) if rename else r


def mapping_of(fields: set[str], by_print: dict[str, dict | None]) -> tuple[str, dict | None]:
    """(fingerprint, layout) of a record's fields; None where no layout fits.

    A fingerprint that is not in the table is that of a record with further fields: it goes to the layout
    with the most fields of those whose fields are all there, and is remembered."""
    fp = fingerprint(fields)
    if fp not in by_print:
        fits = [lay for lay in {id(x): x for x in by_print.values() if x}.values() if fields.issuperset(lay["fields"])]
        if len(by_print) >= MAX_PRINTS:
            return fp, max(fits, key=lambda lay: len(lay["fields"]), default=None)
        by_print[fp] = max(fits, key=lambda lay: len(lay["fields"]), default=None)
    return fp, by_print[fp]


def record_turns(record, by_print: dict[str, dict | None]) -> tuple[str, str | None, list[tuple[int | None, str, str]]]:
    """(fingerprint, layout, [(turn, role, text)]) of one record; layout None where none has its fields."""
    fp, lay = mapping_of(paths(record), by_print)
    if lay is None:
        return fp, None, []
    rename = lay.get("roles", False)
    if "row" in lay:
        role, text, turn = lay["row"]
        return fp, lay["name"], [(record[turn], _role(record[role], rename), _text(record[text]))]
    if "list" in lay:
        key, role, text = lay["list"]
        return fp, lay["name"], [(k, _role(m.get(role), rename), _text(m.get(text))) for k, m in enumerate(record[key])]
    out = []
    for role, src in lay["turns"]:
        got = [_text(record[f]) for f in ([src] if isinstance(src, str) else src) if f in record]
        if got:
            out.append((len(out), role, "\n".join(x for x in got if x) if len(got) > 1 else got[0]))
    return fp, lay["name"], out


def to_turns(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", layouts=None) -> DataFrame:
    """Canonical turns (id_col, turn, role, text, layout, fingerprint) of JSON records of any known layout.

    Fields beyond those of a layout do not matter.  A record that is null, broken or of no known layout
    gives one row of null turn, role, text and layout with its fingerprint (`null` or `broken`), so nothing
    is dropped: unread() lists these and format_chats() leaves them out.  Null text or role: empty.
    Repeated records and ids are records of their own, null ids are kept, texts of any length are whole,
    an empty table gives no rows, and other columns are ignored."""
    kind = records.schema[id_col].dataType.simpleString()

    def convert(batches):
        by_print = mappings(layouts)
        for b in batches:
            out = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    fp, name, turns = record_turns(json.loads(s), by_print) if s is not None else ("null", None, [])
                except (ValueError, KeyError, TypeError, AttributeError):
                    fp, name, turns = "broken", None, []
                out += [(i, t, r, x, name, fp) for t, r, x in turns] if name else [(i, None, None, None, None, fp)]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], [id_col, "turn", "role", "text", "layout", "fingerprint"])

    return records.select(id_col, json_col).mapInArrow(convert, f"`{id_col}` {kind}, turn long, role string, text string, layout string, fingerprint string")


def schema_paths(kind: DataType, at: str = "") -> set[str]:
    """paths() of the values of a column type."""
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def table_turns(rows: DataFrame, id_col: str = "conv_id", layouts=None) -> DataFrame:
    """to_turns() of a table whose columns, beside id_col, are the fields of one layout: the fingerprint is
    that of the schema, and the mapping is made of column expressions.

    Further columns do not matter.  ValueError if no layout fits the schema.  Null roles and texts are empty,
    optional parts that are null are left out, and a null or empty list gives one unread row."""
    fp, lay = mapping_of(schema_paths(rows.drop(id_col).schema), mappings(layouts))
    if lay is None:
        raise ValueError(f"no layout for the schema {rows.drop(id_col).schema.simpleString()}")
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names = {"turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    whole = lambda d, turn, role, text: d.select(id_col, turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(lay["name"]).alias("layout"), F.lit(fp).alias("fingerprint"))
    if "row" in lay:
        role, text, turn = lay["row"]
        return whole(rows, F.col(turn), said(F.col(role)), said(F.col(text)))
    if "list" in lay:
        key, role, text = lay["list"]
        each = rows.select(id_col, F.posexplode_outer(key).alias("_at", "_m"))
        who = said(F.col(f"_m.{role}"))
        if lay.get("roles"):
            known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
            who = F.coalesce(known[F.lower(F.trim(who))], who)
        none = each.where("_at is null").select(id_col, *[v.alias(k) for k, v in names.items()], F.lit(None).cast("string").alias("layout"), F.lit(fp).alias("fingerprint"))
        return whole(each.where("_at is not null"), F.col("_at"), who, said(F.col(f"_m.{text}"))).unionByName(none)
    parts = []
    for role, src in lay["turns"]:
        there = [f for f in ([src] if isinstance(src, str) else src) if f in rows.columns]
        if not there:
            continue
        must = [f for f in there if f in lay["fields"]]
        text = F.array_join(F.filter(F.array(*[said(F.col(f)) for f in there]), lambda x: x != ""), "\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        parts.append(turn if must else F.when(F.col(there[0]).isNotNull(), turn))
    each = rows.select(id_col, F.posexplode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_at", "_m"))
    return whole(each, F.col("_at"), F.col("_m.role"), F.col("_m.text"))


def unread(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, fingerprint) of the records of to_turns() that no layout fits."""
    return turns.where("layout is null").select(id_col, "fingerprint")


# --------------------------------------------------------------------------- template

HEAD, MID, END = "### ", ": ", " </turn>\n"
PART_CHARS = 1 << 16
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TEXT_END = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|:")


def escape(s: str, role: bool = False) -> str:
    return (_CONTROL_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn and the bounds of its text."""
    start = HEAD + escape(role, True) + MID
    body = escape(text)
    return start + body + END, len(start), len(start) + len(body)


def parse(formatted: str):
    """(role, text) of each turn of a formatted text; ValueError where it breaks the template."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEAD, at):
            raise ValueError(f"no turn at {at}")
        end = next((m for m in _ROLE_END.finditer(formatted, at + len(HEAD)) if m[0] == ":"), None)
        stop = next((m for m in _TEXT_END.finditer(formatted, end.end()) if m[0] == "</turn>"), None) if end else None
        if stop is None or formatted[end.start() : end.start() + len(MID)] != MID or formatted[stop.start() - 1 : stop.end() + 1] != END:
            raise ValueError(f"broken turn at {at}")
        yield unescape(formatted[at + len(HEAD) : end.start()]), unescape(formatted[end.start() + len(MID) : stop.start() - 1])
        at = stop.end() + 1


def format_chats(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, part, formatted, loss): the formatted conversations, in parts of whole turns of about
    PART_CHARS, with the loss spans (begin, end) of each part.

    turns: id_col, turn, role, text; rows with a `layout` that is null are left out (see unread()).  The
    loss is on texts of the role `assistant`, spelt so.  Turns in order of (turn, role, text), nulls first; null role and
    text are empty; repeated rows are repeated turns; a null id is a conversation of its own.  Rows are
    streamed in order, so one conversation of any length needs the memory of one part."""
    kind = turns.schema[id_col].dataType.simpleString()
    turns = turns.where("layout is not null") if "layout" in turns.columns else turns
    rows = turns.select(id_col, "turn", "role", "text").repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")

    def write(batches):
        conv, part, held, spans, chars, kind_ = None, 0, [], [], 0, None
        begun = False
        out = []
        for b in batches:
            kind_ = b.schema.field(0).type
            for i, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if begun and (i != conv or chars >= PART_CHARS):
                    out.append((conv, part, "".join(held), spans))
                    part, held, spans, chars = part + 1, [], [], 0
                if not begun or i != conv:
                    conv, part, begun = i, 0, True
                s, lo, hi = render(role or "", text or "")
                if role == "assistant":
                    spans.append({"begin": chars + lo, "end": chars + hi})
                held.append(s)
                chars += len(s)
                if len(out) >= 256:
                    yield batch(out, kind_)
                    out = []
        if begun:
            out.append((conv, part, "".join(held), spans))
            yield batch(out, kind_)

    def batch(out, kind_):
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], kind_), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], span)], [id_col, "part", "formatted", "loss"])

    return rows.mapInArrow(write, f"`{id_col}` {kind}, part long, formatted string, loss array<struct<begin:long,end:long>>")


def read_chats(parts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Parse formatted conversations and digest them: id_col, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Parts are streamed in order through running hashes."""
    kind = parts.schema[id_col].dataType.simpleString()
    rows = parts.select(id_col, "part", "formatted", "loss").repartition(id_col).sortWithinPartitions(id_col, "part")
    names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        state, conv = None, None
        for b in batches:
            out = []
            for i, text, loss in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if state is None or i != conv:
                    if state is not None:
                        out.append((conv, *close(state)))
                    conv, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["begin"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield batch(out, b.schema.field(0).type)
            last = b.schema.field(0).type
        if state is not None:
            yield batch([(conv, *close(state))], last)

    def close(s):
        return s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    def batch(out, kind_):
        c = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c[0], kind_), *(pa.array(c[k], pa.string() if k in (2, 4) else pa.int64()) for k in range(1, 6))], names)

    return rows.mapInArrow(read, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def rows_as_records(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, record): each row of a turn table as a JSON record of the turn-row layout."""
    return rows.select(id_col, F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
