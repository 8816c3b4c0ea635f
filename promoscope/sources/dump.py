"""Rows of SQL dumps: what stands between two opening parentheses outside of quotes.

``spans`` cuts a dump at its true opening parentheses; a record is the text from one
to the next: a row and the comma after it, a column list and ``VALUES``, or any other
part of a statement. Whether a record is a row, and of which table, follows from the
records before it: the context, ``(kind, table, columns)``. An ``INSERT`` (or
``REPLACE``) sets it whatever was before; a comma keeps it. So a range of a file can
sum up its records without knowing the context that it starts in, once for each kind
of context, and the sums of the ranges compose.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

OTHER, COLUMNS, ROW = range(3)          # kinds of context
Context = tuple[int, str | None, str | None]
_UNKNOWN = "\0"                         # a table or column list that an earlier range tells

_QUOTED = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_COMMENT = r"#[^\n]*+(?:\n|\Z)|--(?=\s)[^\n]*+(?:\n|\Z)|/\*.*?\*/"
_WHOLE = _QUOTED + r"|\"[^\"\\]*+(?:(?:\\.|\"\")[^\"\\]*+)*+\"|`[^`]*+`"
_CLOSE = re.compile(r"(?s)" + _WHOLE + "|" + _COMMENT + r"|\)")
_CLEAN = re.compile(r"(?s)(" + _WHOLE + ")|" + _COMMENT)
_PART = r"[`\"]?([^\s(`\".;]+)[`\"]?"
_HEAD = re.compile(r"(?is)(?:\A|;)\s*(?:INSERT|REPLACE)\s+(?:LOW_PRIORITY\s+|DELAYED\s+|HIGH_PRIORITY\s+|IGNORE\s+)*(?:INTO\s+)?(?:" + _PART
                   + r"\s*\.\s*)?" + _PART + r"\s*(\bVALUES?\s*)?\Z")
_VALUES = re.compile(r"(?is)\A\s*VALUES?\s*\Z")
_QUERY = re.compile(r"(?is)\A\s*(?:SELECT|WITH|TABLE)\b")
_AFTER_ROW = re.compile(r"(?is)\A\s*(?:;|,\s*\Z|\Z|ON\s+DUPLICATE\b|AS\b)")
_CLAIM = re.compile(r"(?is)(?:\A|;)\s*(?:INSERT|REPLACE)\s[^;]*\Z")
_NO_ROWS = re.compile(r"(?is)\b(?:SELECT|SET|WITH|TABLE)\b")
_FIELD = re.compile(r"(?s)\s*(?:(" + _QUOTED + r")|([^,'\"]*))\s*(,|\Z)")
_ESCAPED = re.compile(r"(?s)\\(.)|''")
#: Escapes of a quoted text besides the character itself (fixed values).
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "0": "\x00", "b": "\b", "Z": "\x1a"}


def split(record: str) -> tuple[str, bool, str]:
    """A record's text up to its closing parenthesis, whether that is the only one, and the text after the last."""
    if record.count(")") == 1:
        body, _, after = record.partition(")")
        return body, True, after
    ends = [m.start() for m in _CLOSE.finditer(record) if m.group() == ")"]
    if not ends:
        return record, False, ""
    return record[: ends[0]], len(ends) == 1, record[ends[-1] + 1:]


def following(context: Context, body: str, after: str) -> Context:
    """The context of the next record."""
    if after == ",":
        return context if context[0] == ROW else (OTHER, None, None)
    if "-" in after or "#" in after or "/" in after:
        after = _CLEAN.sub(lambda m: m.group(1) or " ", after)
    if context[0] == ROW and after.strip() == ",":
        return context
    head = _HEAD.search(after)
    if head:
        return (ROW if head.group(3) else COLUMNS, head.group(2).lower(), None)
    if context[0] == COLUMNS and _VALUES.match(after):
        return (ROW, context[1], body)
    return (OTHER, None, None)


class Sum:
    """What the records of a range make of each kind of context it may start in."""

    def __init__(self, block: int):
        self.first = block == 0
        self.now: list[Context] = [(OTHER, None, None), (COLUMNS, _UNKNOWN, None), (ROW, _UNKNOWN, _UNKNOWN)]

    def add(self, record: str) -> None:
        body, _, after = split(")" + record if self.first else record)
        self.first = False
        self.now = [following(c, body, after) for c in self.now]

    def text(self) -> str:
        return json.dumps([self.now, self.first])


def contexts(g: pd.DataFrame, rests: list[str | None]) -> list[str]:
    """The context of the first record that begins in each range of a file."""
    context: Context = (OTHER, None, None)
    waiting: str | None = None              # a record left open by an earlier range
    out = []
    for row, rest in zip(g.itertuples(), rests):
        if row.state and row.closed:        # its head completes the open record
            body, _, after = split(waiting or "")
            context, waiting = following(context, body, after), None
        out.append(json.dumps(context))
        if row.closed:
            sums, first = json.loads(row.told)
            kind, table, columns = sums[context[0]]
            context = (kind, context[1] if table == _UNKNOWN else table, context[2] if columns == _UNKNOWN else columns)
            if row.tail is not None:
                waiting = (")" if first else "") + (row.tail if rest is None else f"{row.tail}({rest}")
    return out


def fields(body: str) -> list[str | None]:
    """A row's values: quoted texts with their escapes undone, NULL as None; raises where it is no list of values."""
    out, at = [], 0
    while True:
        m = _FIELD.match(body, at)
        if m is None:
            raise ValueError(f"not a row of the declared columns: ({body[:200]})")
        quoted, plain, more = m.groups()
        if quoted is not None:
            inner = quoted[1:-1]
            if "\\" in inner or "''" in inner:
                inner = _ESCAPED.sub(lambda e: "'" if e.group(1) is None else ESCAPES.get(e.group(1), e.group(1)), inner)
            out.append(inner)
        else:
            plain = plain.strip()
            out.append(None if plain.upper() == "NULL" else plain)
        if not more:
            return out
        at = m.end()


def emitter(columns: list[str], table: str | None, rows: int = 4096) -> Callable:
    """For ``spans.cut_records``: batches of (``fields``: a row's values in the order of ``columns``)."""
    order = [c.lower() for c in columns]
    wanted = table.lower() if table else None

    def emit(block: int, known: str | None, records: Iterator[str]) -> Iterator[pa.RecordBatch]:
        context: Context = tuple(json.loads(known)) if known else (OTHER, None, None)
        first, some, places = block == 0, [], {}
        for record in records:
            body, one, after = split(")" + record if first else record)
            first = False
            if context[0] == ROW and (wanted is None or context[1] == wanted):
                if not one or not (after == "," or _AFTER_ROW.match(_CLEAN.sub(lambda m: m.group(1) or " ", after))):
                    raise ValueError(f"not a row of the declared columns: ({record[:200]}")
                values = fields(body)
                listed = context[2]
                if listed not in places:
                    names = order if listed is None else [c.strip().strip("`\"").lower() for c in listed.split(",")]
                    places[listed] = (len(names), [names.index(c) if c in names else None for c in order])
                count, place = places[listed]
                if len(values) != count:
                    raise ValueError(f"not a row of the declared columns: ({body[:200]})")
                some.append([None if k is None else values[k] for k in place])
                if len(some) >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["fields"])
                    some = []
            then = following(context, body, after)
            if then[0] == OTHER and after != ",":
                told = _CLEAN.sub(lambda m: m.group(1) or " ", after)
                lost = context[0] == COLUMNS and (wanted is None or context[1] == wanted) and not _QUERY.match(told)
                if lost or (_CLAIM.search(told) and not _NO_ROWS.search(told[_CLAIM.search(told).start():])):
                    raise ValueError(f"an INSERT does not parse: {record[-300:]}")
            context = then
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.list_(pa.string()))], names=["fields"])

    return emit
