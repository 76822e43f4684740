"""Fewest-words segmentation of one text; plain Python without Spark.

A word may end only where a character cluster ends.  The text is read from left
to right over the positions that words reach.  Whenever a single position is
left open, everything before it is settled: the segmentation with the fewest
words, and of those the one whose word ends come first in order, is emitted.
Where no position is left, an unknown token is taken: a run (Latin letters, a
number, blanks, a line break) if one starts here, else everything up to the next
cluster end from which a word of more than two bare consonants or a run starts.

A counter of edges since the last settled point bounds ambiguity: once it passes
EDGES_MOST, each further position keeps its shortest word only.  Unknown tokens
count as one edge and don't reset it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

from ..functions import patterns as P

EDGES_MOST = 50
SAMPLE_FROM, SAMPLE_TO = 100, 140

_cluster = re.compile(P.CLUSTER)
_run = re.compile(P.RUN)
_bare = re.compile("[ก-ฮ]{0,2}")
#: Clusters of more than one character are inside such parts of a text.
_thai = re.compile("[ก-๎][ก-๎ ]*")
_plain = re.compile(P.PLAIN_SCAN)


class Lexicon:
    """A compiled dictionary: its words, and all their beginnings."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w for w in words if w)
        self.beginnings = frozenset(w[:k] for w in self.words for k in range(1, len(w) + 1))
        firsts = "".join(re.escape(c) for c in sorted({w[0] for w in self.words}))
        #: Where a word or a run may start, and what a plain text doesn't have.
        self.starts = re.compile(f"[{firsts}]|{P.RUN}" if firsts else P.RUN)
        self.special = re.compile(f"[\\r\u0e00-\u0e7f{firsts}]")

    def ends(self, text: str, start: int) -> Iterator[int]:
        """Ends of the words that start here, nearest first."""
        for end in range(start + 1, len(text) + 1):
            piece = text[start:end]
            if piece not in self.beginnings:
                return
            if piece in self.words:
                yield end


def cluster_ends(text: str) -> bytearray:
    """A flag for each position: whether a cluster ends there."""
    flags = bytearray(b"\1") * (len(text) + 1)
    flags[0] = 0
    for part in _thai.finditer(text):
        a, b = part.span()
        flags[a + 1 : b + 1] = bytes(b - a)
        for m in _cluster.finditer(text, a, b):
            flags[m.end()] = 1
    return flags


def bounds(text: str) -> set[int]:
    return {i for i, flag in enumerate(cluster_ends(text)) if flag}


#: The best way to a position: number of words, position, the way before.
Way = tuple[int, int, "Way | None"]


def _better(one: Way, other: Way) -> bool:
    """Whether a way to some position has fewer words than another, or as many and
    its ends come first in order: what counts is their first difference."""
    if one[0] != other[0]:
        return one[0] < other[0]
    sooner = False
    while one is not other and one is not None:
        if one[1] != other[1]:
            sooner = one[1] < other[1]
        one, other = one[2], other[2]
    return sooner


def _ends(way: Way) -> list[int]:
    out = []
    while way[2] is not None:
        out.append(way[1])
        way = way[2]
    return out[::-1]


def settle(text: str, lexicon: Lexicon) -> list[str]:
    """The tokens of a whole text; joined they give the text again."""
    if not lexicon.special.search(text):
        return _plain.findall(text)
    valid = cluster_ends(text)
    cuts = [0]  # ends of emitted tokens
    best: dict[int, Way] = {0: (0, 0, None)}  # open positions
    open_ = [0]
    edges = 0
    starts: dict[int, bool] = {}

    def word_or_run(at: int) -> bool:
        if at not in starts:
            starts[at] = any(valid[e] and not _bare.fullmatch(text, at, e) for e in lexicon.ends(text, at)) or _run.match(text, at) is not None
        return starts[at]

    def next_start(at: int) -> int:
        while at < len(text):
            m = lexicon.starts.search(text, at)
            if m is None:
                break
            at = m.start()
            if valid[at] and word_or_run(at):
                return at
            at += 1
        return len(text)

    while open_ and open_[0] < len(text):
        at = heapq.heappop(open_)
        way = best.pop(at)
        for end in lexicon.ends(text, at):
            if not valid[end]:
                continue
            edges += 1
            found = (way[0] + 1, end, way)
            if end not in best:
                heapq.heappush(open_, end)
                best[end] = found
            elif _better(found, best[end]):
                best[end] = found
            if edges > EDGES_MOST:
                break
        if len(open_) == 1:
            end = open_[0]
            cuts += _ends(best[end])
            best, edges = {end: (0, end, None)}, 0
        elif not open_:
            run = _run.match(text, at)
            end = run.end() if run else next_start(at + 1)
            edges += 1
            cuts.append(end)
            open_, best = [end], {end: (0, end, None)}
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def parts(text: str, lexicon: Lexicon) -> Iterator[str]:
    """Short parts for the safe mode.

    A part ends inside a sample of 40 characters: after as many characters as
    the sample's last space has before it, plus one, or before the last of the
    sample's longest tokens.
    """
    while len(text) >= SAMPLE_TO:
        sample = text[SAMPLE_FROM:SAMPLE_TO]
        space = sample.rfind(" ")
        if space >= 0:
            cut = space + 1
        else:
            tokens = settle(sample, lexicon)
            longest = max(range(len(tokens)), key=lambda i: (len(tokens[i]), i))
            cut = SAMPLE_FROM + sum(map(len, tokens[:longest]))
        yield text[:cut]
        text = text[cut:]
    if text:
        yield text


def segment_text(text: str | None, lexicon: Lexicon, safe: bool = False) -> list[str]:
    if not text:
        return []
    if safe and len(text) >= SAMPLE_TO:
        return [token for part in parts(text, lexicon) for token in settle(part, lexicon)]
    return settle(text, lexicon)
