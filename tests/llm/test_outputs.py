"""Records, mixing, pseudonyms, licences and the two classifiers."""

import hashlib
import random
import re
import textwrap
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thaiseg.llm import bytekernel, licences, pii, quality, source_mix, storage, token_records, toxicity
from thaiseg.llm.catalog import tokenizer_path

TEXTS = ["", None, "  a  b ", "a\n b", "x y  z", " lead", "tail ", " ", "a b's c", "é 　 b", "it's  \n\n ok\t\tq <|endoftext|> y", "ไข่คน 😀", "the cat sat on the mat " * 50]


def test_encoder_equals_the_library():
    e = token_records.Encoder(tokenizer_path())
    for _ in range(2):  # the second time from the memo
        flat, offsets = e.encode(pa.array(TEXTS))
        whole = e.whole([t or "" for t in TEXTS])
        assert all(np.array_equal(flat[offsets[i] : offsets[i + 1]], w) for i, w in enumerate(whole))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_made_to_collide(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [f"x {w} y" for w in (a, a.translate(str.maketrans("ab", "ba")))]
    encoder = token_records.Encoder(tokenizer_path())
    for group in (texts, texts[::-1]):
        ids, offsets = encoder.encode(pa.array(group))
        for k, t in enumerate(group):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.model.encode(t, add_special_tokens=False).ids


def test_equal_hashes_of_different_pieces(monkeypatch):
    """Every piece of one length has the same hash: nothing comes from another's memo."""
    real = token_records.Words

    class Colliding(real):
        def __init__(self, *a):
            super().__init__(*a)
            self.hashes = self.sizes.astype(np.uint64)

    monkeypatch.setattr(token_records, "Words", Colliding)
    encoder = token_records.Encoder(tokenizer_path())
    for group in (["one two", "six ten"], ["abc one"], ["def", "abc"], ["one one"]):
        ids, offsets = encoder.encode(pa.array(group))
        assert [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(group))] == [encoder.model.encode(t, add_special_tokens=False).ids for t in group]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_records, "MEMO_MOST", 50)
    e = token_records.Encoder(tokenizer_path())
    for k in range(5):
        t = [" ".join(f"word{i}" for i in range(40 * k, 40 * k + 40))]
        assert np.array_equal(e.encode(pa.array(t))[0], e.whole(t)[0]) and len(e.known) <= 50


def test_memo_is_bounded_in_ids(monkeypatch):
    monkeypatch.setattr(token_records, "POOL_MOST", 500, raising=False)
    e = token_records.Encoder(tokenizer_path())
    for k in range(20):
        t = [" ".join(f"some-long-piece/{i}/of-many-ids" for i in range(10 * k, 10 * k + 10))]
        assert np.array_equal(e.encode(pa.array(t))[0], e.whole(t)[0]) and e.used <= 500 + len(e.whole(t)[0])


def traced_peak(run) -> int:
    """Bytes that ``run`` holds at most beyond what there was."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_task_that_writes_records(tmp_path, monkeypatch):
    monkeypatch.setattr(token_records, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(100_000):x}" for _ in range(1000)) for _ in range(400)]
    batch = pa.record_batch({"doc_id": pa.array(range(400)), "text": pa.array(texts)})
    token_records.Encoder.of(tokenizer_path()).clear()
    task = token_records.write_task(f"file://{tmp_path}", tokenizer_path())
    peak = traced_peak(lambda: list(task([batch])))
    assert peak < 30e6


def test_memo_goes_when_the_worker_turns_to_other_texts():
    token_records.Encoder.of(tokenizer_path())
    batch = pa.record_batch({"text": pa.array(["a b"])})
    list(bytekernel.slices([batch], kind=token_records.__name__))
    assert token_records.Encoder._open
    list(bytekernel.slices([batch]))
    assert not token_records.Encoder._open


def test_records_and_mix_start_no_workers_for_rows_of_the_driver(spark, monkeypatch):
    """Rows by ``parallelize`` are read by Python workers of another kind, which take memory beside those of the tasks."""
    df = spark.createDataFrame(mix_rows(n=60), "doc_id long, text string, lang string, source string, n_chars long")
    none = df.limit(0)

    def refused(*a, **b):
        raise AssertionError("parallelize")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert token_records.tokenized(spark, df, tokenizer_path()).count() == 60
    assert source_mix.mixed_documents(spark, df).count() > 0
    assert token_records.tokenized(spark, none, tokenizer_path()).count() == source_mix.mixed_documents(spark, none).count() == 0


def test_records_round_trip(spark):
    ids = [9, 3, 3, None, 7, 1, 4, 12, 30, 2, 8, 15, 22]
    df = spark.createDataFrame(list(zip(ids, TEXTS)), "doc_id long, text string").repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_records.tokenized(spark, df, tokenizer_path()).collect())
    model = token_records.Encoder.of(tokenizer_path())
    start, expected = 0, []
    for key, text in sorted(zip(ids, TEXTS), key=lambda x: (x[0] is not None, x[0], x[1] or "")):
        tokens = np.append(model.whole([text or ""])[0], 0).astype("<u4")
        expected.append((start, key, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert got == expected


def test_damage_is_found():
    raw = token_records.frame(b"payload one") + token_records.frame(b"two")
    first, at = token_records.unframe(raw)
    assert first == b"payload one" and token_records.unframe(raw, at)[0] == b"two"
    for i in range(len(raw)):
        bad = bytearray(raw)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            _, at = token_records.unframe(bytes(bad))
            token_records.unframe(bytes(bad), at)


def test_damaged_shard_fails_the_read(spark):
    folder = storage.new_folder(spark, "damaged")
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    shards = token_records.write_records(spark, df, folder, tokenizer_path())
    path = shards.first().path.removeprefix("file://") + ".rec"
    raw = bytearray(open(path, "rb").read())
    raw[-6] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged payload"):
        token_records.read_records(spark, shards).collect()


def test_water_filling():
    assert source_mix.targets([100, 100, 100], [1, 1, 1], 150, 2) == [50, 50, 50]
    assert source_mix.targets([10, 100], [3, 1], 165, 2) == [20, 145]
    assert source_mix.targets([0, 10], [5, 1], 15, 2) == [0, 15]


def test_draws_add_up_and_permutations_are_whole():
    draws = source_mix.shard_counts(np.array([1000, 0, 37, 4]), 100, 3)
    assert draws.sum(0).tolist() == [1000, 0, 37, 4] and set(draws.sum(1)[:-1]) == {100}
    for n in (1, 2, 3, 7, 64, 65, 1000):
        p = source_mix.permuted(np.arange(n), n, 99)
        assert sorted(p.tolist()) == list(range(n))
    assert source_mix.permuted(np.arange(1000), 1000, 1).tolist() != source_mix.permuted(np.arange(1000), 1000, 2).tolist()


def mix_rows(seed=4, n=400):
    rng = random.Random(seed)
    return [(i, " ".join(f"d{i}x{k}" for k in range(rng.choice([0, 1, 5, 64, 65, 130, 300]))), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", None]), 0) for i in range(n)]


def test_mix_meets_targets_and_reruns_agree(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    one, two = (sorted(tuple(r) for r in source_mix.taken_words(spark, d).collect()) for d in (df, df.repartition(7)))
    assert one == two
    by_source = {r.source: r for r in df.join(source_mix.taken_words(spark, df), "doc_id").groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("of"), F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert list(by_source) and all(r["size"] == r.of for r in by_source.values())
    assert all(abs(r.taken - r.target) <= max(128, 0.02 * r.target) for r in by_source.values())
    assert all(t <= 2 * s for _, s, _, _, t in one)


def test_mixed_documents_hold_the_taken_words(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {}
    for r in source_mix.taken_words(spark, df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words, known = {}, {r[0]: set(r[1].split()) for r in rows}
    for r in source_mix.mixed_documents(spark, df).collect():
        own = r.text.split()
        assert set(own) <= known[r.doc_id] and len(set(own)) == len(own) and r.n_chars == len(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(own)
    assert words == {k: v for k, v in taken.items() if v}


def test_pseudonyms_keep_formats_links_and_validity():
    p, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", undo=True)
    for value, kind in {
        "4111 1111 1111 1111": "card", "9807915762804491": "number", "+1 (017) 555-7713": "phone", "233.254.104.120": "ip", "2024-02-29": "date", "31/12/1999": "date",
        "01.02.2003": "date", "078-05-1120": "ssn", "GB82 WEST 1234 5698 7654 32": "iban", "und.34@mail7.example.com": "email", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce": "secret",
    }.items():
        m = pii.PATTERN.fullmatch(value)
        new, found = p.replace(m)
        assert found == kind and new != value and len(new) == len(value) or kind == "ip", (value, new, found)
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", value) or kind in ("ip", "email", "secret")
        again = pii.PATTERN.fullmatch(new)
        assert again is not None and p.replace(again)[1] == kind
        assert back.replace(again) == (value, kind)
        assert p.replace(m)[0] == new != pii.Pseudonyms(b"other").replace(m)[0]
    for bad in ("999.1.1.1", "2023-02-30", "000-12-3456", "GB83 WEST 1234 5698 7654 32"):
        m = pii.PATTERN.search(bad)
        assert m is None or p.replace(m)[1] in (None, "number")


def test_pseudonyms_in_texts(spark):
    rows = [(1, "mail und.34@mail7.example.com or 233.254.104.120, token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\""), (2, "x und.34@mail7.example.com!! 1 2024 v1.2.3 3,5"), (3, None)]
    out = {r.doc_id: r for r in pii.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    new = re.search(r"\S+@mail7.example.com", out[1].text).group()
    assert new in out[2].text and "und.34" not in out[1].text + out[2].text and "1 2024 v1.2.3 3,5" in out[2].text
    assert (out[1].email, out[1].ip, out[1].secret, out[2].email, out[3].text) == (1, 1, 1, 1, None)
    undone = {r.doc_id: r.text for r in pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in out.values()], "doc_id long, text string"), b"k", undo=True).collect()}
    assert undone == dict(rows)


def test_pseudonyms_of_other_scripts_countries_and_dates():
    p, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", undo=True)
    sub = lambda names, text: pii.PATTERN.sub(lambda m: names.replaced(m)[0], text)
    for text, kind in {
        "müller@firma.de": "email", "josé.garcía@x.es": "email", "jose\u0301@x.es": "email", "иван.петров@почта.рф": "email", "x@bücher.de": "email",
        "+49 30 1234567": "phone", "+33 1 42 68 53 00": "phone", "+33142685300": "phone", "+44 (0)20 7946 0958": "phone", "+44 (20) 7946-0958": "phone",
        "+41.44.668.18.00": "phone", "12/31/1999": "date",
    }.items():
        m = pii.PATTERN.fullmatch(text)
        new, found = p.replace(m)
        assert found == kind and new != text and sub(back, f"a {new}, b") == f"a {text}, b", text
        if kind == "email":
            name, changed = text.split("@")[0], new.split("@")[0]
            assert [c.isalpha() for c in name] == [c.isalpha() for c in changed]
    # letters outside ASCII don't leave the others of the name in clear
    assert not sub(p, "josé.garcía@x.es").startswith("josé") and "garc" not in sub(p, "josé.garcía@x.es")
    phone, card = sub(p, "+49 30 1234567"), sub(p, "4111 1111 1111 1111")
    assert sub(p, "+49 30 1234567 4111 1111 1111 1111") == f"{phone} {card}"
    assert sub(p, "+49 30 1234567 2024-05-01") == f"{phone} {sub(p, '2024-05-01')}"
    for text in ("+1 2", "+1234567", "x +100 x", "13/13/1999", "3 + 4", "+12 5"):
        assert sub(p, text) == text
    assert pii.PATTERN.search("+4930123456789012345").lastgroup == "digits"
    days = [f"{m:02d}/{d}/2001" for m in range(1, 13) for d in range(13, 29)]
    made = [sub(p, d) for d in days]
    assert len(set(made)) == len(days) and all(int(d[3:5]) > 12 for d in made) and [sub(back, d) for d in made] == days


def test_pseudonyms_of_joined_numbers():
    p, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", undo=True)
    sub = lambda names, text: pii.PATTERN.sub(lambda m: names.replaced(m)[0], text)
    one, card, printed = sub(p, "2353820953013749"), sub(p, "4111111111111111"), sub(p, "4111 1111 1111 1111")
    other = sub(p, "4550997810720808")
    assert sub(p, "2353820953013749 4550997810720808") == f"{one} {other}" and one != "2353820953013749"
    assert sub(p, "card-4111111111111111") == f"card-{card}" and printed.replace(" ", "") == card
    day = sub(p, "2024-05-01")
    assert sub(p, "4111 1111 1111 1111 2024-05-01") == f"{printed} {day}" and sub(p, "2024-05-01 4111 1111 1111 1111") == f"{day} {printed}"
    assert sub(p, "4111111111111111 12/26") == f"{card} 12/26" and sub(p, "4111 1111 1111 1111 12/26") == f"{printed} 12/26"
    assert sub(p, "7 4111111111111111-123") == f"7 {card}-123"
    assert sub(p, "4111 1111 1111 1111 10.0.0.1").startswith(f"{printed} ") and "10.0.0.1" not in sub(p, "4111 1111 1111 1111 10.0.0.1")
    assert "99name" not in sub(p, "4111 1111 1111 1111 99name@example.com")
    amex = sub(p, "378282246310005")
    assert sub(p, "12 3782-822463-10005 9").replace("-", "") == f"12 {amex} 9"
    assert sub(p, "411111 1111 111111 2 3 4 5 6")[:18] != "411111 1111 111111" and sub(p, "411111 1111 111111 2 3 4 5 6").endswith(" 2 3 4 5 6")
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(f"{rng.randrange(10 ** n):0{n}d}{rng.choice(' -')}" for n in rng.choices([1, 2, 3, 4, 4, 4, 5, 6, 12, 13, 16, 19, 20], k=rng.randint(1, 14)))
        new = sub(p, text)
        assert sub(back, new) == text and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text), text
        for long in re.findall(r"(?<!\d)\d{13,19}(?!\d)", text):
            assert long not in new


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"z")
    for n in (1, 2, 10, 97, 1000):
        image = [f.permute(x, n, "t") for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.undo(y, n, "t") for y in image] == list(range(n))


def test_licences(spark):
    mit = licences.TEXTS["MIT"][0]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace("\n\n", "\n  \n")), (3, mit + " and more"), (4, "text\n  released under the MIT licence\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, None), (6, "© all")]
    out = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licences.scanned(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("MIT", 0, ""), 2: ("MIT", 0, ""), 3: (None, 0, ""), 4: (None, 3, "CC-BY-NC-4.0,MIT"), 5: (None, 0, ""), 6: (None, 0, "")}
    df = spark.createDataFrame([(t,) for t in [r[1] or "" for r in rows]], "t string")
    assert [r.n for r in df.select(licences.normalised(F.col("t")).alias("n")).collect()] == [licences.normal_form(r[1] or "") for r in rows]


def test_whole_licences_at_published_wraps(spark):
    own = {name: [(licences.Path(licences.__file__).parent / "licence_texts" / f"{name}.txt").read_text()] for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0")}
    cases = [(name, f"Copyright (c) 2001 Someone\n\n{t}") for name, texts in (own | licences.TEXTS).items() for t in texts]
    cases.append(("Apache-2.0", own["Apache-2.0"][0].replace("[yyyy] [name of copyright owner]", "2020 Someone")))
    for name, t in [("Apache-2.0", own["Apache-2.0"][0]), *((name, t) for name, texts in licences.TEXTS.items() for t in texts)]:
        for width in (*range(50, 90), 105):
            cases.append((name, "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False, break_long_words=False) for p in t.split("\n\n"))))
    wrapped = [t for _, t in cases]
    assert any(re.search("^copyright notice", t, re.M) for t in wrapped) and any(re.search(r"^\s*\(c\) ", t, re.M) for t in wrapped)
    digests = dict(licences.known())
    assert [(name, t) for name, t in cases if digests.get(hashlib.sha256(licences.normal_form(t).encode()).hexdigest()) != name] == []
    rows = [(i, t) for i, (_, t) in enumerate(cases)][:40] + [(1000, "My own\nlicence"), (1001, "copyright notice of mine"), (1002, "")]
    more = {"Mine": ["my OWN licence."], "Notice": ["Copyright notice of mine"], "None": ["(c) 2020 Someone"]}
    out = {r.doc_id: r.license for r in licences.scanned(spark, spark.createDataFrame(rows, "doc_id long, text string"), more).collect()}
    assert out == {i: name for i, (name, _) in enumerate(cases[:40])} | {1000: "Mine", 1001: "Notice", 1002: None}


def test_toxicity_learns_words_and_stems():
    rng = random.Random(1)
    plain = [f"w{i}ab" for i in range(400)] + "the of and in der die das le les el los".split()

    def text(bad):
        words = rng.choices(plain, k=rng.randint(5, 120))
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot,", "MORON!!", f"grumpf{rng.choice(plain)}", f"grumpf{rng.choice(plain)}"]))
        return " ".join(words)

    y = np.array([i % 6 == 0 for i in range(2400)]).astype(int)
    texts = [text(b) for b in y]
    model = toxicity.train(texts[:1800], y[:1800], toxicity.Training(epochs=8))
    scores = toxicity.Scorer(model).scores(pa.array(texts[1800:] + ["", None]))
    assert ((scores[:-2] >= 0.5) == y[1800:]).mean() > 0.95 and scores[-1] == scores[-2]


def test_memory_of_training():
    texts = [" ".join(f"w{(i * j) % 977}" for j in range(200)) for i in range(4000)]
    words = 200 * len(texts)
    peak = traced_peak(lambda: toxicity.train(texts, np.arange(4000) % 2, toxicity.Training(epochs=1, steps=1)))
    assert peak < 1.8 * words * 4 * (1 + len(toxicity.PREFIXES))  # once, and the model


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = ["", "a b", *(" ".join(rng.choices(["idiot", "x", "y", "zz"], k=k)) for k in (1, 2, 3, 50, 300))]
    model = toxicity.train(texts * 20, np.array(["idiot" in t for t in texts] * 20).astype(int), toxicity.Training(epochs=1))
    scorer = toxicity.Scorer(model)
    together = scorer.scores(pa.array(texts))
    assert np.allclose(together, [scorer.scores(pa.array([t]))[0] for t in texts], atol=1e-5)


def test_quality_rules_as_columns(spark):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choices("the cat sat on a mat while rain fell over quiet hills".split(), k=60)) + "."
    bad = lambda: rng.choice([" ".join(f"{rng.choice('abc')}x$$$" for _ in range(60)), " | ".join(rng.choices("abcd", k=60)), "spam " * 60])
    texts = [good() if i % 3 else bad() for i in range(600)]
    y = np.array([i % 3 > 0 for i in range(600)], float)
    x = quality.statistics(pa.array(texts))
    rules = quality.fit(x[:400], y[:400])
    z = quality.met(rules.rules, x[400:]) @ np.array(rules.weights) + rules.intercept
    by_hand = 1 / (1 + np.exp(-z))
    assert ((by_hand >= 0.7) == y[400:]).mean() > 0.97
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[400:])], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in quality.with_statistics(df).select("doc_id", rules.column().alias("score")).collect()}
    assert np.allclose([got[i] for i in range(200)], by_hand, atol=1e-5)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "One two.\nOne two.\n\nx", "A | B | c!!", None, "é" * 9, "\n\n", "x x x y"]
    together = quality.statistics(pa.array(texts))
    assert np.allclose(together, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))
    row = dict(zip(quality.STATISTICS, together[1]))
    assert (row["words"], row["lines"], row["repeated_lines"], row["short_lines"]) == (5, 3, 1 / 3, 1)
