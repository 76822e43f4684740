"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, for every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

from thaiseg.llm import decontaminate, licences, line_dedup, ngram_join, pii, quality, simhash, source_mix, token_records, toxicity
from thaiseg.llm.catalog import tokenizer_path

LONG = " ".join(f"word{i % 700}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t", None, None, None),
    (4, "one two", "en", "b", 7),
    (5, "the same text again, with enough words to have shingles\nand two lines", "de", "b", 60),
    (6, "the same text again, with enough words to have shingles\nand two lines", "de", None, 60),
    (6, "the same text again, with enough words to have shingles\nand two lines", "de", None, 60),
    (None, "a row that has no number but has a text", "fr", "c", 39),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + " x", "en", "a", len(LONG) + 2),
    (9, "Thai ไข่คน and 😀 emoji  with  gaps ", "th", "c", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("n", "set", "size", "part", "pos", "own", "shard", "block", "score", "words", "bytes", "digest", "row", "toxic", "th", "line", "item", "hi", "a", "b")


def docs(spark, empty=False):
    df = spark.createDataFrame([] if empty else ROWS, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(4, None, None), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def benchmark(spark):
    rows = [(1, "the same text again, with enough words to have shingles"), (2, None), (3, ""), (4, "no such passage is anywhere in these rows at all"), (None, "row that has no number but has a text")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


OPERATORS = {
    "op1": lambda s, d: simhash.fingerprints_with_edits(s, d),
    "op2": lambda s, d: line_dedup.digests(s, d),
    "op3": lambda s, d: toxicity.toxic_documents(s, d, labels(s), toxicity.Training(epochs=1)),
    "op4": lambda s, d: token_records.tokenized(s, d, tokenizer_path()),
    "op5": lambda s, d: source_mix.taken_words(s, d),
    "op6": lambda s, d: ngram_join.similar_documents(s, d),
    "op7": lambda s, d: quality.quality_scores(s, d, labels(s)),
    "op8": lambda s, d: licences.scanned(s, d),
    "op10": lambda s, d: pii.counted(pii.pseudonymized(d, b"k")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    out = OPERATORS[name](spark, docs(spark)).collect()
    key = lambda x: (x is not None, x)
    assert sorted((r.doc_id for r in out), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark, empty=True)).collect() == []


def test_op1_edges(spark):
    out = {(r.doc_id, r.n_chars): r for r in simhash.fingerprints_with_edits(spark, docs(spark)).collect()}
    assert out[1, 0].fingerprint == out[2, 0].fingerprint == out[3, 3].fingerprint == "0" * 32
    assert out[5, 69].fingerprint == out[6, 69].fingerprint and out[6, 69].near_next == 1.0
    assert out[8, len(LONG) + 2].near_next > 0.95


def test_op2_edges(spark):
    out = {}
    for r in line_dedup.digests(spark, docs(spark)).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [(r.n_lines, r.n_removed) for r in out[1] + out[2] + out[3]] == [(0, 0), (1, 0), (2, 0)]
    assert [r.removed for r in out[5]] == [""] and [r.removed for r in out[6]] == ["0,1", "0,1"]
    assert out[8][0].removed == "0" and out[7][0].removed == ""


def test_op2_without_ids(spark):
    """Equal and similar lines at one line number of different texts without id."""
    words = [f"w{i}" for i in range(60)]
    line, near = " ".join(words), " ".join(words + ["more"])
    df = spark.createDataFrame([(None, f"{line}\nfirst text"), (None, f"{line}\nsecond text"), (None, near), (None, near), (3, line)], "doc_id long, text string")
    out = [(r.doc_id, r.n_lines, r.removed) for r in line_dedup.digests(spark, df).collect()]
    # of three different texts one keeps the line; the equal rows go or stay together
    kept = {(n, removed) for doc, n, removed in out if doc is None}
    ones = [r for r in out if r[:2] == (None, 1)]
    twos = sorted(r[2] for r in out if r[:2] == (None, 2))
    assert (3, 1, "0") in out and len(ones) == 2 and len(set(ones)) == 1
    assert (ones[0][2], twos) in [("", ["0", "0"]), ("0", ["", "0"])], kept


def test_without_repeated_lines_keeps_clashing_columns(spark):
    df = docs(spark).withColumn("removed", F.lit("clash")).withColumn("gone_id", F.lit(1)).withColumn("id", F.lit(2))
    out = line_dedup.without_repeated_lines(spark, df)
    assert out.columns == df.columns
    rows = {(r.doc_id, r.text) for r in out.where("removed = 'clash' AND gone_id = 1 AND id = 2").collect()}
    assert {(1, None), (2, ""), (5, ROWS[4][1]), (6, ""), (8, "")} <= rows and out.count() == len(ROWS)


def test_op5_edges(spark):
    out = source_mix.taken_words(spark, docs(spark)).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert {r.source_size for r in out if r.doc_id in (3, 6)} == {26}


def test_op6_edges(spark):
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(spark, docs(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 9, 5), (6, 9, 5), (None, 6, None), (7, 700, 7), (8, 701, 7)} <= out


def test_op7_and_op3_without_labels(spark):
    none = labels(spark).where("doc_id > 1000")
    assert {r.score for r in quality.quality_scores(spark, docs(spark), none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxic_documents(spark, docs(spark), none).collect()} == {0.0}
    toxic = labels(spark).withColumn("toxic", F.lit(1))
    assert {r.score for r in toxicity.toxic_documents(spark, docs(spark), toxic).collect()} == {1.0}


def test_op9_edges(spark):
    out = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminations(spark, docs(spark), benchmark(spark)).collect()}
    assert out == {(5, 1, 0), (6, 1, 0), (None, None, 0)}
    assert decontaminate.contaminations(spark, docs(spark, True), benchmark(spark)).collect() == []
    assert decontaminate.contaminations(spark, docs(spark), benchmark(spark).limit(0)).collect() == []
    kept = decontaminate.without_contaminated(spark, docs(spark), benchmark(spark))
    assert kept.columns == docs(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 9]


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    import corpus_pipeline

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs(spark, empty), str(tmp_path))
        if name != "token_records":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = out.collect()
        assert bool(rows) != empty, name


def test_pipeline_runs(spark, tmp_path):
    import corpus_pipeline

    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).where("doc_id > 1000").write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {4, 7, 9} and out


def test_near_duplicates_with_repeated_clashing_and_missing_ids(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    texts = [words(0), words(0) + " more", words(1), words(2), words(3), " "]
    rows = [(1, texts[0], "en", "a", 0)] * 3  # equal rows
    rows += [(2, texts[1], "en", "a", 0), (2, texts[2], "en", "a", 0)]  # one id: a near copy of 1, and a text of its own
    rows += [(None, texts[3], "en", "a", 0), (None, texts[3], "en", None, 0), (None, texts[3] + " more", "en", "a", 0)]
    rows += [(None, texts[4], "en", "a", 0), (9, texts[4], None, "b", 0), (9, texts[4], None, "c", 0)]
    rows += [(None, texts[5], "en", "a", 0)] * 2 + [(5, None, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").select("doc_id", "text").collect()]
    expected = [(1, texts[0]), (2, texts[2]), (9, texts[4]), (None, texts[5]), (None, texts[5]), (5, None)]
    rest = list(out)
    for row in expected:
        rest.remove(row)
    assert len(rest) == 1 and rest[0][0] is None and rest[0][1].startswith(texts[3])
