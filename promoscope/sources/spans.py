"""Byte ranges of text files, cut into records whose separators may also occur inside quotes.

A large file is read in ranges by many tasks (Spark's text source splits it), but
where a record begins depends on every quote before. The state at a range's start is
therefore worked out first, by a small automaton whose ranges compose:

1. *Maps*: every task runs its range from every state the automaton can be in at a
   separator, and returns in which state each run ends (runs that meet go on as
   one): one short row a range.
2. *States*: per file, the ranges' maps are applied in order, from the start state.
3. *Heads*: knowing its true state, every range returns the little text before its
   first true separator, which belongs to a record that an earlier range began.
4. *Records*: every task cuts its range again and hands on the records that begin in
   it; the last one is completed with the heads of the following ranges.

Nothing but rows of one a range is ever shuffled, as long as those measure small enough
to be sent to every task; beyond that the pieces are dealt out by range and sorted. A record has
to fit in memory, a range or a file does not.

An automaton is a ``Cutter``: a separator of one character, the number of states (0:
outside of everything, where a separator ends a record) and ``step``, the state
after a piece and the separator behind it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promoscope.operators.star import DEFAULT_MAX_BROADCAST_BYTES, measured_bytes
from promoscope.session import materialize

_ROWS = 4096


class Cutter:
    """CSV records: a quoted field may hold the separator; quotes are doubled inside quotes and open a field only
    at its first character."""

    sep, states = "\n", 2
    #: complete fields and their commas, then an open quoted one (fixed grammar of the format)
    _open = re.compile(r'(?s)(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+,|[^",][^,]*+,|,)*+"[^"]*+(?:""[^"]*+)*+\Z')

    def step(self, state: int, piece: str) -> int:
        if '"' not in piece:
            return state
        return 1 if self._open.match('"' + piece if state else piece) else 0


class SqlCutter(Cutter):
    """SQL text cut at opening parentheses that are in no quotes, names or comments."""

    sep, states = "(", 6
    #: states besides 0: single quotes, double quotes, a quoted name, a comment to the line's end, a comment in marks
    _ENDS = {1: re.compile(r"(?s)[^'\\]*+(?:\\.[^'\\]*+)*+'"), 2: re.compile(r'(?s)[^"\\]*+(?:\\.[^"\\]*+)*+"'),
             3: re.compile(r"[^`]*+`"), 4: re.compile(r"[^\n]*+\n"), 5: re.compile(r"(?s).*?\*/")}
    _BEGINS = {"'": 1, '"': 2, "`": 3, "#": 4, "-": 4, "/": 5}
    #: what is complete outside of quotes
    _plain = re.compile(r"(?s)(?:[^'\"`#/\-]++|'[^'\\]*+(?:\\.[^'\\]*+)*+'|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|`[^`]*+`|#[^\n]*+\n"
                        r"|--(?=\s)[^\n]*+\n|-(?!-\s)|/\*.*?\*/|/(?!\*))*+")
    _marks = re.compile(r"['\"`#/\-]")

    def step(self, state: int, piece: str) -> int:
        if state == 0 and not self._marks.search(piece):
            return 0
        text, at = piece + self.sep, 0
        if state:
            end = self._ENDS[state].match(text)
            if end is None:
                return state
            at = end.end()
        at = self._plain.match(text, at).end()
        return 0 if at == len(text) else self._BEGINS[text[at]]


def pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, value): the files' pieces between separators, in order inside a range."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def is_cut(rows: DataFrame, path: str) -> bool:
    """Whether any file may be read in more than one range. Files' lengths tell where all are short; else the ranges
    are looked at, in one pass."""
    spark = rows.sparkSession
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    short = min(_bytes(spark, "spark.sql.files.openCostInBytes"), _bytes(spark, "spark.sql.files.maxPartitionBytes"))
    return longest > short and bool(rows.agg(F.max("block")).first()[0])


def _bytes(spark: SparkSession, setting: str) -> int:
    """A size setting in bytes (``4194304``, ``16m``, ``128MB``)."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get(setting).strip().lower()).groups()
    return int(number) << (10 * "_kmgt".index(unit or "_"))


def _ranges(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[tuple[tuple, Iterator[str]]]:
    """((file, block, *extra), its pieces) for every range of a task, in order; each must be read to its end."""
    def flat():
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                some = batch.slice(a, _ROWS)
                names = list(zip(*(some.column(c).to_pylist() for c in ("file", "block", *extra))))
                yield from zip(names, some.column("value").to_pylist())

    rows = flat()
    ahead = next(rows, None)
    while ahead is not None:
        name = ahead[0]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[0][:2] == name[:2]:
                piece = ahead[1]
                ahead = next(rows, None)
                yield piece

        yield name, own()


def _with_ranges(rows: DataFrame, ranges: DataFrame, max_bytes: int) -> DataFrame:
    """Every piece with its range's columns, still in order."""
    if measured_bytes(ranges) <= max_bytes:
        return rows.join(F.broadcast(ranges), ["file", "block"])
    told = rows.withColumn("at_", F.monotonically_increasing_id()).join(ranges, ["file", "block"])
    return told.repartition("file", "block").sortWithinPartitions("file", "block", "at_").drop("at_")


def start_states(rows: DataFrame, cutter: Cutter) -> DataFrame:
    """(file, block, state) for every range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in _ranges(batches):
            now = list(range(cutter.states))
            for piece in own:
                after = {s: cutter.step(s, piece) for s in set(now)}
                now = [after[s] for s in now]
            yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()),
                                              "ends": pa.array([now], pa.list_(pa.int32()))})

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        state, out = 0, []
        for ends in g["ends"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"file": g["file"], "block": g["block"], "state": out})

    maps = rows.mapInArrow(run, "file long, block long, ends array<int>")
    return maps.groupBy("file").applyInPandas(fold, "file long, block long, state int")


def heads(rows: DataFrame, states: DataFrame, cutter: Cutter, max_bytes: int, told: Callable | None = None) -> DataFrame:
    """(file, block, state, head, closed, tail, told): the text before a range's first true separator (NULL where it
    starts at one), whether it has one, the record left open at its end, and what ``told`` says of its records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, state), own in _ranges(batches, ("state",)):
            head: list[str] | None = [] if state else None
            outside, some, now, first = state == 0, [], state, state
            note = told(block) if told else None
            for piece in own:
                now = cutter.step(now, piece)
                if not outside:
                    head.append(piece)
                    outside = now == 0
                else:
                    some.append(piece)
                    if now == 0:
                        if note:
                            note.add(cutter.sep.join(some))
                        some = []
            yield pa.RecordBatch.from_pydict({
                "file": pa.array([file], pa.int64()), "block": pa.array([block], pa.int64()), "state": pa.array([first], pa.int32()),
                "head": pa.array([None if head is None else cutter.sep.join(head)], pa.string()), "closed": pa.array([outside]),
                "tail": pa.array([cutter.sep.join(some) if some else None], pa.string()),
                "told": pa.array([note.text() if note else None], pa.string())})

    return _with_ranges(rows, states, max_bytes).mapInArrow(
        run, "file long, block long, state int, head string, closed boolean, tail string, told string")


def rests(g: pd.DataFrame, sep: str) -> list[str | None]:
    """For every range of a file (in order) that leaves a record open: the text that completes it."""
    out: list[str | None] = [None] * len(g)
    rest: list[str] = []
    for k in range(len(g) - 1, -1, -1):
        row = g.iloc[k]
        if row["tail"] is not None:
            out[k] = sep.join(rest) if rest else None
        if row["closed"]:
            rest = [] if row["head"] is None else [row["head"]]
        else:
            rest = [row["head"], *rest]
    return out


def records(own: Iterator[str], state: int, rest: str | None, cutter: Cutter) -> Iterator[str]:
    """The records that begin in a range."""
    outside, some, now = state == 0, [], state
    for piece in own:
        now = cutter.step(now, piece)
        if not outside:
            outside = now == 0
            continue
        if now == 0:
            yield piece if not some else cutter.sep.join([*some, piece])
            some = []
        else:
            some.append(piece)
    if some:
        yield cutter.sep.join(some if rest is None else [*some, rest])


def cut_records(spark: SparkSession, path: str, cutter: Cutter, emit: Callable, schema: str,
                max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES, told: Callable | None = None, context: Callable | None = None) -> DataFrame:
    """What ``emit(block, context, records)`` yields (Arrow batches of ``schema``) for every range and the records
    that begin in it, in order.

    Where records depend on earlier ones, ``told(block)`` makes an object whose ``add(record)`` notes what matters and whose
    ``text()`` sums a range up; ``context(range rows, rests)`` then gives each range's context from the sums of the
    ranges before. Runs jobs while the plan is built if files are read in more than one range."""
    rows = pieces(spark, path, cutter.sep)
    if is_cut(rows, path):
        def fold(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("block").reset_index(drop=True)
            g = g.astype(object).where(g.notna(), None)
            rest = rests(g, cutter.sep)
            return pd.DataFrame({"file": g["file"], "block": g["block"], "state": g["state"], "rest": rest,
                                 "context": context(g, rest) if context else [None] * len(g)})

        states = start_states(rows, cutter)
        found = heads(rows, materialize(states, "ranges"), cutter, max_bytes, told)
        ranges = materialize(found.groupBy("file").applyInPandas(fold, "file long, block long, state int, rest string, context string"), "ranges")
        rows = _with_ranges(rows, ranges, max_bytes)
    else:
        rows = rows.select("*", F.lit(0).alias("state"), F.lit(None).cast("string").alias("rest"), F.lit(None).cast("string").alias("context"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, block, state, rest, known), own in _ranges(batches, ("state", "rest", "context")):
            yield from emit(block, known, records(own, state, rest, cutter))

    return rows.mapInArrow(run, schema)
