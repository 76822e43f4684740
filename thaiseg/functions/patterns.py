"""Patterns and character sets of Thai text, shared by the JVM and Python sides.

Java's and Python's engines read them alike: leftmost alternative first.
"""

from __future__ import annotations

# The code points that are trimmed from dictionary words.
TRIMMED_POINTS = (*range(0x0009, 0x000E), 0x0020, 0x0085, 0x00A0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)
TRIMMED = "".join(map(chr, TRIMMED_POINTS))

# Thai character cluster rules in order of precedence, with
# c for a consonant, t for an optional tone mark and k for an optional
# silenced ending.
CLUSTER_RULES = (
    "เc็ck",
    "เcctาะk",
    "เccีtยะk",
    "เcc็ck",
    "เcิc์ck",
    "เcิtck",
    "เcีtยะ?k",
    "เcืtอะ?k",
    "เctา?ะ?k",
    "cัtวะk",
    "c[ัื]tc[ุิะ]?k",
    "c[ิุู]์k",
    "c[ะ-ู]tk",
    "cรรc์ ็",
    "c็",
    "ct[ะาำ]?k",
    "ck",
    "แc็c",
    "แcc์",
    "แctะ",
    "แcc็c",
    "แccc์",
    "โctะ",
    "[เ-ไ]ct",
)
CONSONANT, TONE = "[ก-ฮ]", "[่-๋]?"
SILENCED = "(?:cc?[ูุิ]?์)?"

# Runs that are tokens of their own where no word is found.
RUNS = ("[-a-zA-Z]+", "[0-9]+(?:[,.][0-9]+)*", "[๐-๙]+(?:[,.][๐-๙]+)*", "[ \\t]+", "\\r?\\n")
RUN_NAMES = ("latin", "digits", "thai_digits", "blank", "newline")
BARE_CONSONANTS = "^[ก-ฮ]{0,2}\\z"


def _expanded(rule: str) -> str:
    return rule.replace("k", SILENCED).replace("c", CONSONANT).replace("t", TONE)


def cluster_pattern(look_ahead: bool = True) -> str:
    """One cluster, or else one character.

    A silenced ending after เ-ิ-ย or เ-ี-ย is cut before its mark, so the mark is
    a cluster of its own; two alternatives with a look-ahead say so.  Engines
    without look-ahead can read the pattern without them, for texts in which
    the shape does not occur.
    """
    rules = [_expanded(r) for r in CLUSTER_RULES]
    if look_ahead:
        cut = "cc?[ูุิ]?(?=์)"
        rules.insert(CLUSTER_RULES.index("เcีtยะ?k"), _expanded("เcีtย" + cut))
        rules.insert(CLUSTER_RULES.index("เcิtck"), _expanded("เcิtย" + cut))
    return "|".join([*rules, "[\\s\\S]"])


CLUSTER = cluster_pattern()
RUN = "|".join(RUNS)
#: For text without Thai letters or digits and without carriage returns: all
#: runs, and whatever stands between them.
PLAIN_SCAN = "[-a-zA-Z]+|[0-9]+(?:[,.][0-9]+)*|[ \\t]+|\\r?\\n|[^-a-zA-Z0-9 \\t\\n]+"
