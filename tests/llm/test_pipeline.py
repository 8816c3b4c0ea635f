import subprocess
import sys

import corpus_pipeline as P
from promoscope.llm import decontam
from test_line_dedup import brute as brute_lines
from test_ngram_join import brute as brute_classes


def test_stages_against_brute_force(spark, tmp_path):
    line = lambda i: f"Line number {i} tells the story of the {i * 7} brown foxes and their {i * 3} dogs."
    item = "The benchmark asks which of the seven dwarfs wore the longest beard in the winter of the great flood."
    rows = [(i, "\n".join(line(10 * i + k) for k in range(6)), "en", "src0", 0) for i in range(1, 12)]
    rows += [(20, rows[0][1], "en", "src0", 0), (21, rows[1][1] + "\nOne line of its own in this copy.", "en", "src0", 0),
             (22, f"Some words before it. {item} And some after it.", "en", "src1", 0), (23, "12345 !!!", "en", "src1", 0),
             (24, None, None, None, None), (25, "", "en", "src1", 0), (26, "la maison et le jardin sont dans la ville\n" + line(11), "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, n = docs.columns, 0
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage-{n}")
        docs, n = spark.read.parquet(f"{tmp_path}/stage-{n}"), n + 1
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert {23, 24, 25}.isdisjoint(after) and {1, 11, 26} <= set(after)
        elif name == "line_dedup":
            assert after == {k: t for k, t in brute_lines(before).items() if t}
            assert 20 not in after and after[21] == "One line of its own in this copy."
        elif name == "near_duplicates":
            assert set(after) == {c for _, _, c in brute_classes(before, 5, 80)}
        elif name == "decontamination":
            assert set(after) == {k for k, _ in before} - {22}
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert all(r.lossless for r in docs.collect()) and decontam.Q > 0


def test_rest_works_without_the_folders():
    """The entry point, with the corpus modules hidden, still registers the reports."""
    code = ("import sys, importlib.abc\n"
            "class Hide(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'promoscope.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Hide())\n"
            "import __spark_entry__ as e\n"
            "assert 'q3_campaign_revenue' in e.queries() and not any(k.startswith('op') for k in e.queries())\n"
            "assert 'op1_url_filters' not in e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=P.__file__.rsplit("/", 1)[0])
