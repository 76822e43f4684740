import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thaiseg.operators.lattice import Lexicon, bounds, parts, segment_text, settle
from thaiseg.plans.queries import CAPPED, CASE_WORDS, CASES, CLUSTER_CASES, SAFE, UNKNOWN, WORDS

ALPHABET = "กขคนมราเแโไาะิีุู่้์็ค่าจ้าง ab1,๑.\n"


def all_segmentations(text, lexicon, valid, start=0):
    if start == len(text):
        yield ()
    for end in lexicon.ends(text, start):
        if end in valid:
            for rest in all_segmentations(text, lexicon, valid, end):
                yield (end, *rest)


@pytest.mark.parametrize("text", CLUSTER_CASES)
def test_bounds(text):
    assert bounds(text) == set(CLUSTER_CASES[text])


@pytest.mark.parametrize("cases,words,safe", [(CASES, WORDS + CASE_WORDS, False), (UNKNOWN, (*WORDS, "42"), False), (CAPPED, WORDS, False), (SAFE, WORDS, True)])
def test_expected_tokens(cases, words, safe):
    lexicon = Lexicon(words)
    for text, tokens in cases.items():
        assert tuple(segment_text(text, lexicon, safe)) == tokens


def test_whole_phrase_wins_over_its_words():
    phrase = "ห้องสมุดประชาชนเทศบาลตำบลวิชิต"
    assert segment_text(phrase, Lexicon((*WORDS, *CASE_WORDS, phrase))) == [phrase]


def test_null_and_empty():
    assert segment_text(None, Lexicon(WORDS)) == [] == segment_text("", Lexicon(WORDS), True)


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.booleans())
def test_tokens_tile_the_text(text, safe):
    lexicon = Lexicon([*WORDS, "กา", "มา", "นา", "ab", "1,"])
    tokens = segment_text(text, lexicon, safe)
    assert "".join(tokens) == text and all(tokens)
    assert "".join(parts(text, lexicon)) == text


def test_fewest_words_then_nearest_ends_by_brute_force():
    rng = random.Random(1)
    letters = "กขคง"
    for _ in range(300):
        words = {"".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(8)} | set(letters)
        text = "".join(rng.choices(letters, k=rng.randint(1, 9)))
        lexicon = Lexicon(words)
        best = min(all_segmentations(text, lexicon, bounds(text)), key=lambda ends: (len(ends), ends))
        got = settle(text, lexicon)
        ends, at = [], 0
        for token in got:
            at += len(token)
            ends.append(at)
        assert len(ends) == len(best) and tuple(ends) == best
