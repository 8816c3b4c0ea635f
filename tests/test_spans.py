"""Files read in many byte ranges (S1, S5): records that cross ranges, separators inside quotes, against plain parsers."""

import csv
import io
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promoscope.sources import dump, spans
from promoscope.sources.retail import has_line_breaks, read_csv_typed, read_insert_tuples

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])
NASTY = ["'", "''", "\\", "),(", ";\n", "\n", '"', '""', ",", "\n\n", ", NULL", "(", ")", "INSERT INTO t VALUES (1,2,3);", "-- ", "/*", "*/", "#", "`", "é", "x" * 40, "\r\n", " "]


@pytest.fixture
def narrow(spark):
    """Ranges of about 100 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(files):
    d = tempfile.mkdtemp(prefix="promoscope-test-", dir="/tmp")
    for i, text in enumerate(files):
        with open(os.path.join(d, f"f{i}.txt"), "w", newline="", encoding="utf-8") as fh:
            fh.write(text)
    return d


def _texts(rng, n):
    return ["".join(rng.choices(NASTY + list("abc"), k=rng.randint(0, 6))) for _ in range(n)]


def _csv(rows, eol):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=eol)
    writer.writerow(["a", "b", "n"])
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed,eol", [(1, "\n"), (2, "\r\n")])
def test_csv_in_ranges_equals_a_plain_parser(spark, narrow, seed, eol):
    rng = random.Random(seed)
    rows = [(a, b, rng.randint(-5, 5)) for a, b in zip(_texts(rng, 120), _texts(rng, 120))]
    rows[60] = ("long\n" * 100, "crosses many ranges", 7)
    d = _write([_csv(rows[:90], eol), _csv(rows[90:], eol), _csv([], eol)])
    assert has_line_breaks(spark, d)
    df = read_csv_typed(spark, d, SCHEMA, na=("",), trim=False)
    assert df.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((a or None, b or None, n) for a, b, n in rows), key=str)


def test_csv_without_line_breaks_is_read_plainly(spark, narrow):
    rows = [(f"say \"{i}\"", "x, y", i) for i in range(60)]
    d = _write([_csv(rows, "\n")])
    df = read_csv_typed(spark, d, SCHEMA)
    assert not has_line_breaks(spark, d) and "FileScan csv" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)


def test_csv_files_with_other_headers_raise(spark, narrow):
    d = _write(['a,b,n\n"x\ny",b,1\n', "b,a,n\nx,y,2\n"])
    with pytest.raises(Exception, match="other headers"):
        read_csv_typed(spark, d, SCHEMA).collect()


def _sql(value, rng):
    if value is None:
        return rng.choice(["NULL", "null"])
    if isinstance(value, int):
        return str(value)
    text = value.replace("\\", "\\\\")
    text = "".join(rng.choice(["''", "\\'"]) if c == "'" else rng.choice(["\n", "\\n"]) if c == "\n" else c for c in text)
    return f"'{text}'"


def _dump(rng, rows, other):
    """Statements of random length, spacing, column lists, comments and other tables' rows."""
    out, at = ["-- it's a dump (of t\nCREATE TABLE `t` (a varchar(10), b text COMMENT 'x),(', n int(11));\n/* don't ( */\n"], 0
    while at < len(rows):
        some = rows[at: at + rng.choice([1, 3, 40])]
        at += len(some)
        listed = rng.random() < 0.4
        head = rng.choice(["INSERT INTO `t` ", "insert ignore into db.`t`", "INSERT INTO\n t "]) + ("(`n`, a ,b)" if listed else "")
        body = [",".join(_sql(v, rng) for v in ((r[2], r[0], r[1]) if listed else r)) for r in some]
        out.append(f"{head} VALUES ("
                   + rng.choice(["),(", ") , (", "),\n  ("]).join(body) + ")" + rng.choice([";\n", " ;", ";\n-- that's it (\n"]))
        if rng.random() < 0.3:
            out.append(f"INSERT INTO `u` VALUES ({_sql(rng.choice(other), rng)},'INSERT INTO `t` VALUES (1,2,3);',9);\nUPDATE t SET a = 'b(' WHERE n IN (1, 2);\n")
    return "".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_dump_in_ranges_equals_what_was_written(spark, narrow, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([a, None]), b, rng.choice([None, rng.randint(-9, 9)])) for a, b in zip(_texts(rng, 150), _texts(rng, 150))]
    rows[70] = ("(),'\n;" * 200, "crosses many ranges", 7)
    d = _write([_dump(rng, rows[:120], _texts(rng, 9)), _dump(rng, rows[120:], _texts(rng, 9)), "", "-- nothing\n"])
    df = read_insert_tuples(spark, d, SCHEMA, table="T")
    assert df.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)


def test_one_long_statement_runs_in_as_many_tasks_as_ranges(spark, narrow):
    rows = [(f"v{i}", "a),(b;\n", i) for i in range(2000)]
    rng = random.Random(3)
    text = "INSERT INTO t VALUES (" + "),(".join(",".join(_sql(v, rng) for v in r) for r in rows) + ");"
    d = _write([text])
    df = read_insert_tuples(spark, d, SCHEMA, table="t")
    assert df.rdd.getNumPartitions() >= len(text) // 4000
    assert df.agg(F.count("*"), F.sum("n")).first() == (2000, 1999 * 1000)
    used = df.select("n", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(used) > 10 and max(r["count"] for r in used) < 500


def test_ranges_beyond_a_broadcast(spark, narrow):
    """The range table dealt out by a join instead of a broadcast gives the same records."""
    rows = [("x\ny" if i % 3 else "z", "b", i) for i in range(80)]
    d = _write([_csv(rows, "\n")])

    def emit(block, known, records):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array(list(records), pa.string())], names=["r"])

    got = [spans.cut_records(spark, d, spans.Cutter(), emit, "r string", max_bytes=n) for n in (1 << 26, 0)]
    assert "BroadcastHashJoin" in got[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, got[1].collect())) and got[0].count() == 81


def test_an_unreadable_row_in_a_later_range_raises(spark, narrow):
    text = "INSERT INTO t VALUES " + ",".join(f"('a{i}','b',{i})" for i in range(100)) + ",('z','y');\n"
    with pytest.raises(Exception, match="not a row"):
        read_insert_tuples(spark, _write([text]), SCHEMA, table="t").collect()


@pytest.mark.parametrize("cutter", [spans.Cutter(), spans.SqlCutter()])
def test_states_compose(cutter):
    """The state after two pieces is the second one's step from the state after the first."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices(NASTY + ["a", "'", '"', "--  ", "- -"], k=12))
        whole = [0]
        for piece in text.split(cutter.sep):
            whole.append(cutter.step(whole[-1], piece))
        if cutter.sep == "(" and not any(x in text for x in "\\-/#`\""):
            assert whole[-1] == text.count("'") % 2
        if cutter.sep == "\n" and '"' not in text:
            assert set(whole) == {0}


def test_fields_of_a_row():
    assert dump.fields("1, 'a''b', null ,'', NULL,'NULL', -2.5e3,'x\\ny\\\\\\'z'") == ["1", "a'b", None, "", None, "NULL", "-2.5e3", "x\ny\\'z"]
    with pytest.raises(ValueError):
        dump.fields("1, 'a' 'b'")
