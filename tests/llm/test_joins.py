"""The set joins and the searches against brute force."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thaiseg.llm import bytekernel, decontaminate, line_dedup, ngram_join, set_pairs, simhash, storage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, width=5):
    w = WORD.findall(fold(text or ""))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        i = rng.randrange(len(words) + 1)
        kind = rng.choice("sid")
        if kind == "i":
            words.insert(i, rng.choice("alpha beta gamma".split()))
        elif words and i < len(words):
            if kind == "d":
                del words[i]
            else:
                words[i] = rng.choice("alpha beta gamma".split())
    return words


def corpus(seed=5):
    """Families of near copies at all degrees, of many sizes; a passage that
    most texts share; texts that are little but that passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for size in [3, 4, 5, 6, 8, 12, 20, 33, 64, 66, 90, 128, 130, 200, 260, 515, 1030]:
        for _ in range(4):
            base = rng.choices(words, k=size)
            for k in range(6):
                one = edited(rng, base, rng.randint(0, max(1, size // 25)) * (k > 0))
                if rng.random() < 0.5:
                    at = rng.randrange(len(one) + 1)
                    one[at:at] = passage
                texts.append((" " if rng.random() < 0.7 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in one))
    for _ in range(60):
        texts.append(" ".join(passage + rng.choices(words, k=rng.randint(0, 25))))
    texts += texts[:20] + ["", "\t"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("id_bits", [64, 6])
def test_ngram_join_equals_brute_force(spark, monkeypatch, id_bits):
    """With six bits nearly all sets have the hash of some other one."""
    monkeypatch.setattr(set_pairs, "COMMON_MIN", 6)
    texts = corpus()
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if similar(sets[i], sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(spark, df, id_bits=id_bits).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts) - 100


def signatures(sets, common=()):
    """The signatures of each set."""
    table = set_pairs.Common(np.array(sorted(common), np.uint64), np.arange(len(common)) % 7)
    sig, of = ngram_join.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), table, (3, 4))
    return [set(sig[of == i].tolist()) for i in range(len(sets))]


def at_threshold(rng, a):
    """Sets whose similarity with a is 3/4 or just above, of all sizes."""
    n = len(a)
    yield np.sort(rng.choice(a, -(-n * 3 // 4), replace=False))
    yield np.unique(np.concatenate([a, rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
    gone = n // 7  # (n - k) / (n + k)
    yield np.unique(np.concatenate([rng.choice(a, n - gone, replace=False), rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))


def test_signatures_of_similar_sets_meet():
    """Without the table of common shingles, on sets at the threshold exactly."""
    rng = np.random.default_rng(2)
    for size in [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 30, 32, 33, 48, 49, 64, 65, 86, 96, 100, 128, 171, 300, 700, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            sets = [a, *at_threshold(rng, a)]
            made = signatures(sets)
            assert all(made[0] & m for m in made[1:])


@pytest.mark.parametrize("plan", [*ngram_join.PLANS, ngram_join.Plan(1 << 62, (1, 6), 5, 2)])
def test_subset_signatures_alone(plan):
    """Similar sets that have enough partitions share a subset, without the finest case."""
    rng = np.random.default_rng(12)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    for b in at_threshold(rng, a):
        values = np.concatenate([a, b])
        owner = np.repeat([0, 1], [len(a), len(b)])
        needed = np.array([len(a), len(b)]) // 3 // (plan.left_out + 1) + 1
        sig, of, full = ngram_join.subset_signatures(values, owner, np.array([1024, 1024]), needed, plan)
        assert (full >= needed).any() and set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_common_shingles_keep_the_guarantee():
    rng = np.random.default_rng(4)
    common = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    for _ in range(100):
        own = np.unique(np.concatenate([rng.choice(common, 120), rng.integers(0, 1 << 63, int(rng.integers(1, 120)), dtype=np.uint64)]))
        made = signatures([own, *at_threshold(rng, own)], common)
        assert all(made[0] & m for m in made[1:])


def test_thresholds_below_one_half_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for f in (ngram_join.similar_documents, line_dedup.removed_lines):
        with pytest.raises(ValueError):
            f(spark, df, ratio=(2, 5))


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (5, 900, 1000, 1100, 1900, 2100, 9000)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    made = set_pairs.Sketches(set_pairs.sketches(np.concatenate(rows), offsets, np.ones(len(rows), bool), 1024))
    i, j = np.triu_indices(len(rows), 1)
    for x, y, d in zip(i.tolist(), j.tolist(), made.apart(i, j).tolist()):
        assert d <= len(np.setxor1d(rows[x], rows[y])) and (d > 0)


def test_near_pairs_of_groups_cut_anywhere(monkeypatch):
    """All pairs of equal group and fitting size, however rows come in batches."""
    monkeypatch.setattr(set_pairs, "PAIRS", 50)
    rng = np.random.default_rng(3)
    gid, n = np.sort(rng.integers(0, 12, 300)), rng.integers(1, 60, 300)
    table = pa.table({"gid": gid, "n": n, "at": np.arange(300), "sketch": pa.array([bytes(32)] * 300, pa.binary())})
    got = set()
    for part, group in set_pairs.whole_groups(iter(table.to_batches(max_chunksize=7)), ["gid"], rows=40):
        size = part.column("n").to_numpy()
        order = np.lexsort((size, group))
        made = set_pairs.Sketches(part.column("sketch").take(pa.array(order)))
        at = part.column("at").to_numpy()[order]
        for i, j, apart in set_pairs.near_pairs(group[order], size[order], made, (3, 4), lambda i, j: (i + j) % 5 > 0):
            assert not apart.any() and not ((i + j) % 5 == 0).any()
            got |= {frozenset(p) for p in zip(at[i].tolist(), at[j].tolist())}
    fits = {frozenset((x, y)) for x, y in itertools.combinations(range(300), 2) if gid[x] == gid[y] and 4 * min(n[x], n[y]) >= 3 * max(n[x], n[y])}
    assert got < fits and len(got) > 0.7 * len(fits)


def test_groups_covered_by_the_signature_before():
    before = np.array([0, 0, 5, 5, 7, 8, 8, 8, 9], np.uint64)
    first, size = np.array([0, 2, 4, 6]), np.array([2, 2, 2, 3])
    assert set_pairs.uncovered(before, first, size).tolist() == [True, False, True, True]
    assert set_pairs.uncovered(before, first[:0], size[:0]).tolist() == []


def test_members_of_groups_are_not_broadcast(spark):
    """The copies of a group's row would all go to the driver; small groups have one."""
    sizes = {gid: size for gid, size in enumerate([2, 7, 127, 128, 500, 5000])}
    members = spark.createDataFrame([(g, n, 1000 * g + k) for g, n in sizes.items() for k in range(n)], "gid long, size long, set long")
    groups = spark.range(len(sizes)).where("id <> 1").select(F.col("id").alias("gid"), F.element_at(F.array(*[F.lit(n).cast("long") for n in sizes.values()]), F.expr("CAST(id AS INT) + 1")).alias("size"))
    got = set_pairs.within(members, groups)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, got.select("gid", "set").collect())) == [(g, 1000 * g + k) for g, n in sizes.items() if g != 1 for k in range(n)]


@pytest.mark.parametrize("known", [32, 2])
def test_a_pair_is_listed_by_its_first_group(monkeypatch, known):
    """Of many groups with nearly the same sets only one lists a pair, if the sets
    know all their groups; no pair is lost if they don't."""
    monkeypatch.setattr(ngram_join, "FIRST_GROUPS", known)
    rng = random.Random(8)
    groups = {g: sorted(rng.sample(range(24), rng.randint(7, 20))) for g in rng.sample(range(-1000, 1000), 20)}
    of = {s: sorted(g for g, sets in groups.items() if s in sets)[:known] for s in range(24)}
    rows = [{"set": s, "gid": g, "comp": s, "n": 10, "sketch": bytes(128), "p": 0, "q": 0, "side": 2, "firsts": of[s]} for g in sorted(groups) for s in groups[g]]
    table = pa.Table.from_pylist(rows, pa.schema([("set", pa.int64()), ("gid", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("p", pa.int32()), ("q", pa.int32()), ("side", pa.int32()), ("firsts", pa.list_(pa.int64()))]))
    got = [(x["a"], x["b"]) for batch in ngram_join.rest_task((3, 4), False)(iter(table.to_batches(50))) for x in batch.to_pylist()]
    want = {pair for sets in groups.values() for pair in itertools.combinations(sets, 2)}
    assert set(got) == want and (known == 2 or len(got) == len(want))


def test_the_forest_names_members_with_other_pairs():
    """Every possible pair is in the forest, or one of its groups names both; nothing
    else is named: none in one component, far apart or of unlike sizes."""
    near, far = bytes(128), bytes([255]) * 64 + bytes(64)
    groups = {
        5: [(1, 1, 10, near), (2, 2, 10, near), (3, 3, 10, near), (4, 4, 10, far), (5, 5, 30, near)],
        6: [(1, 1, 10, near), (2, 2, 10, near), (3, 3, 10, near)],
        7: [(7, 7, 10, near), (8, 7, 10, near), (9, 9, 10, near), (4, 4, 10, far)],
        8: [(9, 9, 10, near), (7, 7, 10, near), (4, 4, 10, far)],
        9: [(8, 7, 10, near), (7, 7, 10, near)],
    }
    rows = [{"set": s, "gid": g, "whole": 100 + g, "comp": c, "n": n, "sketch": k, "p": 0, "q": 0, "side": 2} for g, own in groups.items() for s, c, n, k in own]
    table = pa.Table.from_pylist(rows, pa.schema([(x, pa.int64()) for x in ("set", "gid", "whole", "comp", "n")] + [("sketch", pa.binary()), ("p", pa.int32()), ("q", pa.int32()), ("side", pa.int32())]))
    out = [x for batch in ngram_join.rest_task((3, 4), True)(iter(table.to_batches(3))) for x in batch.to_pylist()]
    pairs = {(x["a"], x["b"]) for x in out if x["a"] is not None}
    open_ = {5: {(1, 2), (1, 3), (2, 3)}, 6: {(1, 2), (1, 3), (2, 3)}, 7: {(7, 9), (8, 9)}, 8: {(7, 9)}}
    assert len(pairs & open_[5]) == 2 and len(pairs & open_[7]) == 1 and len(pairs) == 3
    left = {(x["gid"], x["size"], x["set"]) for x in out if x["a"] is None}
    assert left == {(g, 100 + g, s) for g in (5, 7) for pair in open_[g] - pairs for s in pair}


def test_the_second_pass_only_reads_what_the_forest_leaves(spark, monkeypatch):
    """Families that share half of their texts have many large groups and no
    possible pair; of families of near copies few members are left."""
    rng = random.Random(21)
    words, texts = [f"w{i}" for i in range(4000)], []
    for _ in range(12):
        half = rng.choices(words, k=80)
        texts += [" ".join(half + rng.choices(words, k=80)) for _ in range(12)]
    for size in (90, 150, 300):
        base = rng.choices(words, k=size)
        texts += [" ".join(edited(rng, base, rng.randint(0, size // 22))) for _ in range(15)]
    sets = [shingle_set(t) for t in texts]
    component = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if similar(sets[i], sets[j]) and component[i] != component[j]:
            lo, hi = sorted((component[i], component[j]))
            component = [lo if c == hi else c for c in component]
    read, rest = {}, ngram_join._rest

    def counted(members, info, comps, ratio, forest):
        read[forest] = [r.set for r in members.select(F.explode("members").alias("set") if "members" in members.columns else "set").collect()]
        return rest(members, info, comps, ratio, forest)

    monkeypatch.setattr(ngram_join, "_rest", counted)
    got = ngram_join.similar_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(component))
    assert 0 < len(read[False]) < len(read[True]) / 4, (len(read[False]), len(read[True]))


def test_hot_keys_are_dealt(spark):
    rows = spark.createDataFrame([(7, i) for i in range(4000)] + [(i, 1) for i in range(100, 900)] + [(None, 5)], "k long, v long")
    hot = storage.hot_values(rows, "k")
    assert hot == [7]
    other = spark.createDataFrame([(7, "x"), (100, "y")], "k long, w string")
    joined = storage.salted_join(rows, other, "k", hot, "v")
    assert joined.groupBy("w").count().orderBy("w").collect() == [("x", 4000), ("y", 1)]
    assert storage.salted_join(rows, other, "k", hot, "v", how="left").count() == 4801
    salt = rows.where("k = 7").selectExpr(f"pmod(xxhash64(v), {storage.SALTS}) AS s").groupBy("s").count().agg({"count": "max"}).first()[0]
    assert salt < 3 * 4000 / storage.SALTS


def thue_morse(n):
    """Two strings of n letters that polynomial hashes modulo 2**64 don't tell apart."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_made_to_collide(spark, n):
    texts = list(thue_morse(n))
    df = spark.createDataFrame([(i, f"{t} x y z u v w") for i, t in enumerate(texts)] + [(i + 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.similar_documents(spark, df).collect()} == {0, 1, 2, 3}
    assert {tuple(r.removed) for r in line_dedup.removed_lines(spark, df).collect()} == {()}


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(set_pairs, "COMMON_MIN", 6)
    rng = random.Random(8)
    pool = [t.replace("\n", " ") for t in corpus(9)]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 5))) for _ in range(150)] + ["", "\n\n"]
    rows = [(d, k, shingle_set(line)) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    expected: dict[int, list[int]] = {d: [] for d in range(len(texts))}
    seen: list[frozenset] = []
    for d, k, own in rows:
        if own and any(similar(own, other) for other in seen):
            expected[d].append(k)
        if own:
            seen.append(own)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(spark, df).collect()}
    assert got == expected
    cleaned = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark, df).collect()}
    assert cleaned == {d: "\n".join(line for k, line in enumerate(t.split("\n")) if k not in expected[d]) if expected[d] else t for d, t in enumerate(texts)}


def test_line_dedup_of_chains_in_large_groups(spark, monkeypatch):
    """Lines of 11 words, each like the one before only; B and C both follow A.
    In some documents A, B and C share a token that the first line lacks, which
    matched A, and C is the centre: B is then the only open line of the group."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", 2)
    monkeypatch.setattr(set_pairs, "SMALL_GROUP", 2)
    lines = lambda d: [[f"d{d}w{i + k}" for i in range(11)] for k in range(3)]
    families = [(x, a, b, b[:-1] + [f"d{d}other"]) for d in range(1500) for x, a, b in [lines(d)]]
    x, a, b, c = (shingle_set(" ".join(own)) for own in families[0])
    assert similar(x, a) and similar(a, b) and similar(b, c) and not similar(x, b) and not similar(x, c)
    df = spark.createDataFrame([(d, "\n".join(" ".join(own) for own in f)) for d, f in enumerate(families)], "doc_id long, text string")
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(spark, df).collect()}
    assert {d: k for d, k in got.items() if k != [1, 2, 3]} == {} and len(got) == len(families)


def test_fingerprints_and_neighbours(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(60)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(128), k)) for b in base for k in (1, 2, 3, 4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = {(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints}
    df = spark.createDataFrame(sorted(halves), "hi long, lo long")
    got = {((r.hi, r.lo), (r.other_hi, r.other_lo), r.distance) for r in simhash.neighbours(df, 3).collect()}
    bits = lambda a, b: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))
    assert got == {(a, b, bits(a, b)) for a, b in itertools.combinations(sorted(halves), 2) if bits(a, b) <= 3}


@pytest.mark.parametrize("group", [3, 4096])
def test_near_counts_by_brute_force(spark, monkeypatch, group):
    """A dense cluster and far fingerprints, with large keys dealt in groups or not."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(7)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(128), k)) for b in base for k in range(0, 12, 2)} | {base[0] ^ (1 << i) for i in range(60)} | {0, 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints] * 2, "hi long, lo long")
    got = {(r.hi, r.lo): (r.n_near, r.nearest) for r in simhash.near_counts(df, simhash.RADIUS, simhash.BLOCKS).collect()}
    want = {}
    for p in prints:
        near = [d for q in prints if 0 < (d := (p ^ q).bit_count()) <= simhash.RADIUS]
        if near:
            want[signed(p >> 64), signed(p & ((1 << 64) - 1))] = (len(near), min(near))
    assert got == want and max(n for n, _ in got.values()) > 50
    for radius, blocks in ((3, 3), (-1, 2), (6, 14)):
        with pytest.raises(ValueError):
            simhash.near_counts(df, radius, blocks)


def test_rows_of_block_tables_are_not_broadcast(spark):
    """28 rows for each fingerprint, which Spark takes for one."""
    prints = spark.range(50).select(F.xxhash64("id").alias("hi"), F.xxhash64("id", F.lit(1)).alias("lo"))
    plan = simhash.near_counts(prints, simhash.RADIUS, simhash.BLOCKS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprint_votes_by_hand(spark):
    """One term alone gives its own hash bits; likeness follows what texts share."""
    words = [f"term{i}" for i in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:270] + [f"other{i}" for i in range(30)])), (2, " ".join(f"far{i}" for i in range(300))), (3, "  " + "\n".join(words))]
    out = {r.doc_id: r for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart = lambda a, b: (int(out[a].fingerprint, 16) ^ int(out[b].fingerprint, 16)).bit_count()
    assert apart(0, 3) == 0 and apart(0, 1) < 35 < apart(0, 2) and len(out[0].fingerprint) == 32


def edit_distance_to_run(item, words):
    """Sellers' recurrence cell by cell."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in words:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(column[i] + (x != w), column[i + 1] + 1, new[i] + 1))
        column = new
        best = min(best, column[-1])
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    words = "the of and in to is that for with was".split() + [f"w{i}" for i in range(300)]
    items = [rng.choices(words, k=k) for k in (1, 2, 3, 5, 6, 7, 8, 9, 12, 15, 20, 30, 40, 40, 60)]
    texts = []
    for _ in range(250):
        i = rng.randrange(len(items))
        k = int(len(items[i]) * 0.25)
        noise = lambda: rng.choices(words, k=rng.randint(0, 60))
        texts.append(" ".join(noise() + edited(rng, items[i], rng.randint(0, k)) + noise()))
    expected = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if edit_distance_to_run(item, t.split()) <= int(len(item) * 0.2 + 1e-9):
                expected.add((d, i))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminations(spark, df, benchmark).collect()}
    assert set(got) <= expected
    assert len(got) >= 0.97 * len(expected)
    for (d, i), distance in got.items():
        assert distance >= edit_distance_to_run(items[i], texts[d].split())


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_MOST", 2)
    rows = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}") for i in range(7)]
    df = spark.createDataFrame([(i, f"x y {t} z") for i, t in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, df, benchmark).collect()} == {(i, i) for i in range(7)}
    assert decontaminate.without_contaminated(spark, df, benchmark).count() == 0


def test_what_is_broadcast_of_long_items_is_small():
    """1,000 items of 50 to 1,049 words; every one is found in itself."""
    import pickle

    texts = [" ".join(f"i{i}w{k % (40 + i % 9)}x{k // 7}" for k in range(50 + i)) for i in range(1000)]
    items = decontaminate.Items(list(range(1000)), pa.array(texts), decontaminate.Search())
    assert len(pickle.dumps(items)) < 50 << 20
    found = decontaminate.found_in(items, pa.array(texts[::97]))
    assert {(j, i): 0 for j, i in enumerate(range(0, 1000, 97))} == {k: v[0] for k, v in found.items() if v[0] == 0}


def test_a_run_common_to_very_many_items(monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 1 << 10)
    texts = [f"read the text and answer in one word question{i} topic{i * 7} name{i * 3}" for i in range(400)]
    items = decontaminate.Items(list(range(400)), pa.array(texts), decontaminate.Search(max_edits=0.1))
    found = decontaminate.found_in(items, pa.array([texts[5] + " " + "read the text and answer in one word " * 30, texts[399]]))
    assert set(found) == {(0, 5), (1, 399)}


def test_words_and_shingles_of_the_kernel():
    texts = ["", None, "a", "A b", " x\ty\nz\x0bw\x0cv\ru ", "é ü é ü é ü é", "one two three four five six", "x" * 100]
    w = bytekernel.Words(*bytekernel.utf8(pa.array(texts)))
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    elements, offsets = bytekernel.distinct_within(*bytekernel.shingles(w))
    assert np.diff(offsets).tolist() == [len(shingle_set(t)) for t in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + [None])], names=["text"])]
    assert [len(b) for b in bytekernel.slices(batches, most=30)] == [3, 3, 2]


def packed(sigs, sets, buckets=1):
    """Postings as candidate tasks of the n-gram join read them."""
    n = np.full(len(sets), 100, np.uint16)
    return list(set_pairs.packed_postings([sets, n, np.zeros(len(sets), np.uint64)], sigs, buckets, ngram_join._POSTINGS))


def test_memory_of_a_task_that_lists_candidates(monkeypatch):
    """A bucket is sorted in parts, with the same pairs and groups as in one."""
    rng = np.random.default_rng(5)
    n = 1 << 20
    sigs = rng.integers(0, 1 << 32, n, dtype=np.uint64)
    sigs[4000:24000] = sigs[24000:44000]  # pairs
    sigs[:4000] = rng.integers(0, 1 << 32, 400, dtype=np.uint64).repeat(10)  # 400 equal groups
    sets = rng.integers(0, 1 << 62, n)
    sets[:4000] = np.tile(sets[:10], 400)
    batches, task = packed(sigs, sets), ngram_join.candidate_task((3, 4))
    tracemalloc.start()
    found = pa.Table.from_batches(task(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    gids = found["gid"].drop_null().to_pylist()
    assert gids and len(gids) == len(set(gids))
    monkeypatch.setattr(set_pairs, "PART_POSTINGS", n)
    whole = pa.Table.from_batches(task(iter(batches)))
    told = lambda t: sorted(map(str, t.to_pylist()))
    assert told(found) == told(whole)
