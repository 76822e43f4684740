import pathlib
import subprocess
import sys
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from thaiseg.functions import text as X
from thaiseg.functions.segmenting import register, segment, spread
from thaiseg.operators.dictionary import Dictionary
from thaiseg.operators.lattice import Lexicon, bounds, segment_text
from thaiseg.operators.prefixes import edges, words_at
from thaiseg.operators.registry import Registry
from thaiseg.plans.native import shortest_segmentations
from thaiseg.plans.queries import WORDS
from thaiseg.sources.lines import main, segment_files
from thaiseg.sources.shared import shared_folder
from thaiseg.streaming.lines import line_stream, segment_stream


def words(dictionary):
    return {r.word for r in dictionary.words.collect()}


def test_dictionary_steps(spark):
    d = Dictionary.from_words(spark, ["ศาล"])
    assert d.count() == 1
    d = d.add(["ศาล", "  ศาล "])
    assert d.count() == 1
    d = d.add(["ศาลา"])
    assert d.count() == 2
    assert d.remove(["ลา"]).count() == 2 and words(d.remove(["ศาลา"])) == {"ศาล"}
    assert d.remove(["ศาลา", "ศาล", ""]).count() == 0


def test_dictionary_file_is_trimmed(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_bytes("﻿ปฏิวัติ\r\nปฏิรูป\nปฏิเสธ \n\nปฏิบัติ\n ปฏิรูป \n".encode())
    d = Dictionary.from_file(spark, str(path))
    assert words(d) == {"ปฏิวัติ", "ปฏิรูป", "ปฏิเสธ", "ปฏิบัติ"}
    with pytest.raises(AnalysisException):
        Dictionary.from_file(spark, str(tmp_path / "absent.txt")).count()


def test_contains_is_exact(spark):
    d = Dictionary.from_words(spark, ["กากบาท", "กาแฟ", "กรรม", "42", "aง|.%"])
    rows = spark.createDataFrame([("กาแฟ",), ("กาแฟ ",), ("42",), (None,)], "w string")
    assert d.count() == 5
    assert {(r.w, r.contained) for r in d.contains(rows, "w").collect()} == {("กาแฟ", True), ("กาแฟ ", False), ("42", True), (None, False)}


def test_too_large_a_dictionary_is_refused(spark, monkeypatch):
    monkeypatch.setattr("thaiseg.operators.dictionary.COMPILED_MOST", 2)
    with pytest.raises(ValueError):
        Dictionary.from_words(spark, ["ก", "ข", "ค"]).compiled


def test_registry(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("ไข่\nคน\n", encoding="utf-8")
    r = Registry(spark)
    assert r.load_dict(str(path), "a")[1] is True
    message, ok = r.load_dict(str(path), "a")
    assert not ok and message == "Failed: dictionary name a already exists, please use another name."
    assert r.segment("ไข่คน2021", "a", parallel=True) == ["ไข่", "คน", "2021"]
    assert r.segment(None, "absent") == [] and r.segment("", "absent") == [] and r.segment(7, "absent") == []
    with pytest.raises(RuntimeError, match="Dictionary name absent does not exist."):
        r.segment("x", "absent")


def test_native_bounds_equal_python_ones(spark):
    texts = ["พิสูจน์ได้ค่ะ", "เรือน้อยลอยอยู่", "เบียร์", "เดิยกุ์x", "", "a\nก\r😀", *WORDS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.cluster_bounds("t").alias("b"), X.clusters("t").alias("c")).collect()
    for r in rows:
        assert set(r.b) == bounds(r.t) and "".join(r.c) == r.t


def test_trim_and_characters(spark):
    row = spark.createDataFrame([(" \t​ abc　\n", "เบียร์😀 x ")], "a string, b string").select(X.trimmed("a"), X.chars_len("b"), X.char_at("b", 6), X.last_space("b"), X.char_slice("b", 1, 3), X.is_bare_consonants(F.lit("\n"))).first()
    assert tuple(row) == ("abc", 10, "😀", 9, "บี", False)


def test_udf_sql_and_table_function(spark):
    d = Dictionary.from_words(spark, WORDS)
    register(spark, d, "seg")
    spark.createDataFrame([(1, "ไข่คน2021"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("t")
    assert [r[0] for r in spark.sql("SELECT seg(text) FROM t ORDER BY id").collect()] == [["ไข่", "คน", "2021"], [], []]
    assert [r[0] for r in spark.sql("SELECT seg_safe(text) FROM t ORDER BY id").collect()][0] == ["ไข่", "คน", "2021"]
    assert [tuple(r) for r in spark.sql("SELECT id, r.pos, r.token FROM t, LATERAL seg_rows(text) r ORDER BY ALL").collect()] == [(1, 0, "ไข่"), (1, 1, "คน"), (1, 2, "2021")]


def test_joins_agree_with_the_lattice(spark):
    texts = [(i, WORDS[i % 11] + WORDS[i * 7 % 11] + WORDS[i * 5 % 11]) for i in range(60)]
    rows = spark.createDataFrame(texts, "id int, text string")
    got = {r.id: r.tokens for r in shortest_segmentations(rows, "id", "text", Dictionary.from_words(spark, WORDS), 4).collect()}
    lexicon = Lexicon(WORDS)
    assert got == {i: segment_text(t, lexicon) for i, t in texts}


#: Keys that repeat or are missing; the first two texts end clusters in other places.
ODD_ROWS = [(1, "กาก็กา"), (1, "ากาก็"), (None, "ไข่คน"), (2, None), (3, ""), (4, "ก"), (5, "😀ค่าจ้าง ab\n"), (6, "ค่าจ้างเพื่อชีวิต" * 3)]
ODD_WORDS = [*WORDS, "กา", "า", "ก", "ก็", "😀", "b\n", "ab", "ยาว" * 40]


@pytest.mark.parametrize("few", [True, False])
def test_words_at_and_edges_of_each_row(spark, monkeypatch, few):
    monkeypatch.setattr("thaiseg.operators.dictionary.FEW_WORDS", 1000 if few else 0)
    d, known = Dictionary.from_words(spark, ODD_WORDS), [w.strip() for w in ODD_WORDS]
    rows = spark.createDataFrame(ODD_ROWS, "id int, text string")
    found = [(k, p, w, p + len(w), t) for k, t in ODD_ROWS for w in known for p in range(len(t or "")) if t.startswith(w, p)]
    order = lambda x: (str(x[0]), *x[1:])
    assert sorted(map(tuple, words_at(rows, "id", "text", d).collect()), key=order) == sorted((x[:4] for x in found), key=order)
    assert sorted(map(tuple, edges(rows, "id", "text", d).collect()), key=order) == sorted((x[:4] for x in found if x[3] in bounds(x[4])), key=order)
    assert edges(rows, "id", "text", d).dtypes == [("id", "int"), ("pos", "int"), ("word", "string"), ("end", "int")]
    assert edges(rows, "id", "text", d.remove(ODD_WORDS)).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_probes_and_bounds_are_not_built(spark, monkeypatch, few):
    """Joins broadcast the words, or build a task's share of them; never what explode made of the rows."""
    monkeypatch.setattr("thaiseg.operators.dictionary.FEW_WORDS", 1000 if few else 0)
    d = Dictionary.from_words(spark, WORDS)
    for find in (words_at, edges):
        rows = find(spark.range(100).selectExpr("id", "concat('ไข่คน', id) AS text"), "id", "text", d)
        assert rows.count() == 200
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Join ") == 1 and "SortMergeJoin" not in plan and "LeftSemi" not in plan
        join = "BroadcastHashJoin [word" if few else "ShuffledHashJoin [word"
        assert join in plan and "BuildRight" in plan and plan.count("BroadcastExchange") == few


def test_segment_plan_has_one_arrow_step(spark):
    plan = spark.range(1).select(segment(F.lit("ก"), Dictionary.from_words(spark, WORDS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_line_job_batch_stream_and_shell(spark, tmp_path, monkeypatch, capsys):
    source, dictionary = tmp_path / "in", tmp_path / "d.txt"
    source.mkdir()
    (source / "a.txt").write_text("ไข่คน2021\n\n1) คน\n", encoding="utf-8")
    dictionary.write_text("ไข่\nคน\n", encoding="utf-8")
    expected = ["", "1|)| |คน", "ไข่|คน|2021"]
    segment_files(spark, str(source), str(tmp_path / "out"), str(dictionary))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == expected
    segment_stream(line_stream(spark, str(source)), Dictionary.from_file(spark, str(dictionary)), str(tmp_path / "out2"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out2")).collect()) == expected
    monkeypatch.setattr("sys.stdin", (source / "a.txt").open(encoding="utf-8"))
    assert main(["-d", str(dictionary), "-s", "/"]) == 0
    assert capsys.readouterr().out == "ไข่/คน/2021\n\n1/)/ /คน\n"


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    source = pathlib.Path(e.__file__).read_text()
    assert "def entry(" in source


def test_registry_takes_any_name(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("ไข่\n คน \n", encoding="utf-8")
    known = Registry(spark)
    for name in ("a-b", "my dict", "ไทย", ""):
        assert known.load_dict(str(path), name)[1] and not known.load_dict(str(path), name)[1]
        known.add(name, ["ไก่"])
        known.remove(name, ["คน"])
        assert known.segment("ไข่ไก่คน", name) == ["ไข่", "ไก่", "คน"] and known.dictionary(name).count() == 2


def test_clashing_columns(spark):
    d = Dictionary.from_words(spark, ["a", "b"])
    rows = spark.createDataFrame([("a", 1, "x"), ("c", 2, "y"), (None, 3, "z")], "word string, known int, row string")
    out = d.contains(rows, "word")
    assert out.columns == ["word", "known", "row", "contained"] and sorted(r.known for r in out.collect() if r.contained) == [1]
    with pytest.raises(ValueError):
        d.contains(out, "word")
    with pytest.raises(ValueError):
        words_at(rows.withColumnRenamed("known", "pos"), "pos", "word", d)


def test_spread_and_line_ends(spark, tmp_path):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64
    words = tmp_path / "words.txt"
    words.write_text("ไข่\nคน\n", encoding="utf-8")
    run = subprocess.run([sys.executable, "-m", "thaiseg.sources.lines", "-d", str(words)], input="ไข่คน\r\nไข่\rคน\n\nคน".encode(), capture_output=True, check=True)
    assert run.stdout.decode().split("\n") == ["ไข่|คน", "ไข่|\rคน", "", "คน", ""]  # two bare consonants don't end an unknown token


def test_linear_on_repeated_consonants():
    """With two words of bare consonants: four times the text, about four times the time."""
    lexicon = Lexicon(["กก", "กกก"])

    def seconds(n):
        began = time.perf_counter()
        assert "".join(segment_text("ก" * n, lexicon)) == "ก" * n
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(64_000) for _ in range(3)) < 12 * min(seconds(16_000) for _ in range(3))


def test_shared_folder_is_refused_on_a_cluster_without_a_setting():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session)
