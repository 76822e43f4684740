"""The queries' columns against plain Python, on small tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from thaiseg.llm import pii, quality, simhash, source_mix, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=60, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)] + ["Ünïcode", "ไข่", "😀", "and"]
    return [None, "", " "] + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n - 6)] + ["a b c"] * 3


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_beside_the_edited_text(spark, monkeypatch, parts):
    """Several ranges of ids as well; the last document is followed by the first."""
    monkeypatch.setattr(simhash, "partitions_for", lambda spark: parts)
    own = texts()
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in simhash.fingerprints_with_edits(spark, df).collect()}
    plain = lambda rows: {r.doc_id: r.fingerprint for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole, edited = [t or "" for t in own], {}
    for i, t in enumerate(whole):
        half = len(t) // 2
        edited[i] = t[: len(t) - half] + whole[i - 1][:half]  # descending ids: after 0 comes the last one, the first
    prints, edits = plain(list(enumerate(whole))), plain(list(edited.items()))
    likeness = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    for i, t in enumerate(whole):
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i], edits[i])
        near = [d for p in set(prints.values()) if 0 < (d := (int(p, 16) ^ int(prints[i], 16)).bit_count()) <= simhash.RADIUS]
        assert (r.n_near, r.nearest) == (len(near), min(near, default=None))
        assert r.near_edited == likeness(prints[i], edits[i]) and r.near_next == likeness(prints[i], prints[(i - 1) % len(whole)])


def test_sizes_and_bounds_of_the_mix(spark):
    rng = random.Random(6)
    rows = [(i, t, rng.choice([None, "a", "B", "é", "a" * 3])) for i, t in enumerate(texts(300, 7))]
    out = {r.doc_id: r for r in source_mix.taken_words(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), source_mix.Mix(block=16)).collect()}
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    per_source: dict = {}
    for i, _, s in rows:
        per_source[s] = per_source.get(s, 0) + sizes[i]
    order = sorted((s for s in per_source if s is not None)) + [None]
    weights = dict(zip(order, [3, 1, 2] * 3))
    left, open_, target = 1.5 * sum(per_source.values()), set(order), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > 2 * per_source[s]]
        target |= {s: 2.0 * per_source[s] for s in over} if over else {s: left * weights[s] / total for s in open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    for i, _, s in rows:
        r = out[i]
        assert (r["size"], r.source_size) == (sizes[i], per_source[s]) and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * sizes[i]
    for s in order:
        assert abs(sum(out[i].taken for i, _, x in rows if x == s) - target[s]) <= 2 * 16


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_folds_and_predictions(spark, name):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(40)], ["awful", "horrid", "nasty", "vile"]
    rows, labels = [], []
    for i in range(500):
        y = rng.random() < 0.4
        rows.append((i, " ".join(rng.choices(good, k=30) + (rng.choices(bad, k=4) + ["!!!"] * 9 if y else []))))
        labels.append((i, int(y), int(y)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    folds, out_fold, limit, f = {"toxicity": (5, 0, 0.5, toxicity.toxic_documents), "quality": (4, 2, 0.7, quality.quality_scores)}[name]
    out = {r.doc_id: r for r in f(spark, docs, known).collect()}
    held = {i for i in out if zlib.crc32(str(i).encode()) % folds == out_fold}
    assert held == {i for i, r in out.items() if r.held_out}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in out.values())
    right = [out[i].predicted == labels[i][1] for i in held]
    assert sum(right) >= 0.9 * len(right)
    # labels of the held-out rows play no part
    turned = known.withColumn("toxic", F.when(F.col("doc_id").isin(sorted(held)), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(F.col("doc_id").isin(sorted(held)), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in f(spark, docs, turned).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_pseudonyms_of_a_table_by_the_row(spark):
    """Every row as the function alone makes it, and back with the key."""
    own = [t if t is None else t + f" call (555) 010-{i:04d} or mail user{i}@host.example on 2024-05-{1 + i % 28:02d}" for i, t in enumerate(texts())]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    made = pii.pseudonymized(df, b"k")
    names = pii.Pseudonyms(b"k")
    out = {r.doc_id: r for r in made.collect()}
    for i, t in enumerate(own):
        assert out[i].text == (None if t is None else pii.PATTERN.sub(lambda m: names.replaced(m)[0], t))
        if t is not None:
            assert (out[i].phone, out[i].email, out[i].date) == (1, 1, 1) and out[i].text != t
    back = {r.doc_id: r.text for r in pii.pseudonymized(made.select("doc_id", "text"), b"k", undo=True).collect()}
    assert back == dict(enumerate(own))
