"""PII: format-preserving Feistel pseudonyms.

Found values are validated and replaced by values of the same format: digits
stay digits and letters letters, separators and lengths stay, and what was valid
stays valid.  A keyed Feistel permutation of the value's own domain makes the
replacement, so equal values get equal pseudonyms in every document, different
values of one format different ones, and the key's holder can undo it.

kind    found and validated                         permuted
card    13-19 digits that pass the Luhn check       all digits but the check digit, made anew
number  13-19 digits that don't                     digits; the result never passes the check
iban    two letters, ISO 7064 mod 97 holds          digits of the account part; check digits made anew
ssn     ddd-dd-dddd of an assignable range          digits, walked until assignable
phone   (ddd) ddd-dddd; +, 8 to 15 digits, joined   the last seven digits
ip      four octets up to 255                       the 32-bit address
date    yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, real    the day number within 1900 to 2099
date    mm/dd/yyyy that isn't dd/mm/yyyy            the same, walked until it isn't either
email   name@host.tld, letters of any script        letters, marks and digits of the name
secret  32-64 hexadecimal digits                    hexadecimal digits

A date of month first is linked with others of its form only.  Letters are
permuted within their block of 128 code points and their category, so é becomes
another small Latin letter.

Digits joined by single spaces or hyphens may be several numbers, or a number and
something else (``number_spans`` tells them apart).  Equal numbers get equal
pseudonyms, except in a run where the new digits would be told apart otherwise.
Of more than 19 joined digits in other groupings than cards are printed in, only
what passes the Luhn check is taken, in six groups at most.

Defined results: null texts stay null, empty ones empty; texts without values are
unchanged; rows are independent of each other, so repeated rows repeat; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import only

ROUNDS = 8
KINDS = ("card", "number", "iban", "ssn", "phone", "ip", "date", "email", "secret")
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049

# names and hosts in any script, combining marks included
_EMAIL = r"(?u:(?<![\w\u0300-\u036f.+-])[\w\u0300-\u036f.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
_SECRET = r"(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
_DATE = r"(?<![\d.])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\d.]*\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
# a plus and 8 to 15 digits in groups, up to a group that begins a card, a date or an address by its shape
_CARD = r"\d{13,}|\d{4}(?:[ -]\d{4}){3}(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
_SHAPES = rf"{_CARD}|\d{{4}}-\d\d-\d\d(?!\d)|\d\d[/.]\d\d[/.]\d{{4}}(?!\d)"
_JOINT = rf"(?: (?!\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?!\d|\.\d))(?!{_SHAPES})|[.-](?!{_SHAPES})|[ .-]?\(|\)[ .-]?)"
_WORLD = rf"(?<![\d+])\+(?!\d{{16}}|\d{{4}}(?:[ -]\d{{4}}){{3}}(?!\d))[1-9](?:{_JOINT}?\d){{7,14}}(?!\d)"
_EXPIRY = r"\d\d/\d\d(?!\d)"
# groups of digits joined by single spaces or hyphens, up to one that begins something else
_GROUP = rf"(?!{_EMAIL}|{_SECRET}|{_DATE}|{_SSN}|{_IP}|{_EXPIRY})\d{{1,19}}(?!\d)"
PATTERN = re.compile(
    rf"(?P<email>{_EMAIL})"
    rf"|(?P<secret>{_SECRET})"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    rf"|(?P<date>{_DATE})"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    rf"|{_WORLD})"
    rf"|(?P<ssn>{_SSN})"
    rf"|(?P<ip>{_IP})"
    rf"|(?P<digits>(?<!\d)(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -]{_GROUP})*)",
    re.ASCII,
)
#: How cards are printed, by digits of the groups; longer ones first.
CARD_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
#: Of other groupings, so many groups may be a card within more digits, and so
#: many digits are looked at together.
GROUPS_MOST, DIGITS_MOST = 6, 57


class Feistel:
    """A keyed permutation of 0..n-1 for any n: Feistel rounds on the least even
    number of bits, walked until the result is below n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, r: int, x: int, mask: int) -> int:
        size = (mask.bit_length() + 7) // 8
        out = b"".join(hashlib.blake2b(tweak + x.to_bytes(size, "big"), key=self.key, digest_size=64, person=bytes([r, k])).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out, "big") & mask

    def permute(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, range(ROUNDS), 1)

    def undo(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak, range(ROUNDS - 1, -1, -1), -1)

    def _walk(self, x: int, n: int, tweak: str, rounds: range, way: int) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        mask, salt = (1 << half) - 1, f"{tweak}/{n}/".encode()
        while True:
            left, right = x >> half, x & mask
            for r in rounds:
                if way > 0:
                    left, right = right, left ^ self._round(salt, r, right, mask)
                else:
                    left, right = right ^ self._round(salt, r, left, mask), left
            x = (left << half) | right
            if x < n:
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def number_spans(run: str) -> list[tuple[int, int]]:
    """Where the numbers of 13 to 19 digits are in a run of joined groups: groups
    of so many digits, then printed card groupings (of two that overlap, one that
    passes the Luhn check, then the longer), then in what is left the longest
    spans that pass the check, or all of it if it has 13 to 19 digits."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    sizes = [b - a for a, b in groups]
    plain = [run[a:b] for a, b in groups]
    taken = [13 <= n <= 19 for n in sizes]
    spans = [g for g, t in zip(groups, taken) if t]

    def take(found: list[tuple[int, int]]) -> None:
        for i, j in found:
            if not any(taken[i:j]):
                taken[i:j] = [True] * (j - i)
                spans.append((groups[i][0], groups[j - 1][1]))

    printed = []
    for i in range(len(groups)):
        for shape in CARD_GROUPS:
            j = i + len(shape)
            if tuple(sizes[i:j]) == shape:
                valid = luhn("".join(plain[i:j]))
                if valid or shape in ((4, 4, 4, 4), (4, 6, 5)):
                    printed.append((not valid, -sum(shape), i, j))
    take([x[2:] for x in sorted(printed)])
    for piece in _pieces(sizes, taken):
        i, j = piece[0], piece[-1] + 1
        found = []
        for a in range(i, j):
            n = 0
            for b in range(a, j):
                n += sizes[b]
                if n > 19:
                    break
                if n >= 13 and (b - a < GROUPS_MOST or (a, b + 1) == (i, j)) and luhn("".join(plain[a : b + 1])):
                    found.append((-n, a, b + 1))
        if not found and 13 <= sum(sizes[i:j]) <= 19:
            found = [(0, i, j)]
        take([x[1:] for x in sorted(found)])
    return sorted(spans)


def _pieces(sizes: list[int], taken: list[bool]) -> list[list[int]]:
    """Neighbouring groups that aren't taken, of DIGITS_MOST digits at most together."""
    out: list[list[int]] = [[]]
    held = 0
    for i, n in enumerate(sizes):
        if taken[i] or held + n > DIGITS_MOST:
            out.append([])
            held = 0
        if not taken[i]:
            out[-1].append(i)
            held += n
    return [x for x in out if x]


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _day(text: str) -> int | None:
    a = re.split(r"[-/.]", text)
    year, month, day = a if len(a[0]) == 4 else a[::-1]
    try:
        return datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None


def _into(template: str, digits: str) -> str:
    """``digits`` in the places of the template's digits."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in template)


@functools.lru_cache(4096)
def _alphabet(c: str) -> str:
    """What a character may become: its like among the 128 code points of its block."""
    kind = unicodedata.category(c)
    if kind[0] not in "LMN":
        return c
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)


class Pseudonyms:
    def __init__(self, key: bytes, undo: bool = False):
        f = Feistel(key)
        self.move: Callable[[int, int, str], int] = f.undo if undo else f.permute

    def replace(self, match: re.Match) -> tuple[str, str | None]:
        """The value's pseudonym and kind; (the value, None) if it isn't valid."""
        made, kinds = self.replaced(match)
        return made, kinds[0] if kinds else None

    def replaced(self, match: re.Match) -> tuple[str, tuple[str, ...]]:
        """The same with the kinds of all values; a run of digits may hold several."""
        kind, value = match.lastgroup, match.group()
        if kind == "digits":
            return self._run(value)
        made = getattr(self, f"_{kind}")(value)
        return (made, (kind,)) if made is not None else (value, ())

    def _run(self, value: str) -> tuple[str, tuple[str, ...]]:
        spans, made = number_spans(value), value
        kinds = tuple("card" if luhn(re.sub(r"\D", "", value[a:b])) else "number" for a, b in spans)
        while spans:
            for a, b in spans:
                made = made[:a] + self._digits(made[a:b]) + made[b:]
            # walked until the numbers are found at the same places again, so it can be undone
            if number_spans(made) == spans:
                break
        return made, kinds

    def _digits(self, value: str) -> str:
        d = re.sub(r"\D", "", value)
        n, body = 10 ** (len(d) - 1), int(d[:-1])
        right = next(c for c in "0123456789" if luhn(d[:-1] + c))
        new = str(self.move(body, n, "digits")).zfill(len(d) - 1)
        new_right = next(c for c in "0123456789" if luhn(new + c))
        # the distance from the right check digit is kept, so validity is
        return _into(value, new + str((int(d[-1]) - int(right) + int(new_right)) % 10))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain) != 1:
            return None
        digits = "".join(c for c in plain[4:] if c.isdigit())
        if not digits:
            return None
        account = _into(plain[4:], str(self.move(int(digits), 10 ** len(digits), "iban")).zfill(len(digits)))
        check = str(98 - mod97(plain[:2] + "00" + account)).zfill(2)
        source = iter(plain[:2] + check + account)
        return "".join(c if c == " " else next(source) for c in value)

    def _ssn(self, value: str) -> str | None:
        fits = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = value.replace("-", "")
        if not fits(d):
            return None
        while True:
            d = str(self.move(int(d), 10**9, "ssn")).zfill(9)
            if fits(d):
                return _into(value, d)

    def _phone(self, value: str) -> str:
        d = re.sub(r"\D", "", value)
        return _into(value, d[:-7] + str(self.move(int(d[-7:]), 10**7, f"phone/{d[:-7]}")).zfill(7))

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255:
            return None
        x = self.move(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        day = _day(value)
        if day is None:
            return self._month_first(value) if "/" in value else None
        d = datetime.date.fromordinal(_FIRST_DAY + self.move(day - _FIRST_DAY, _DAYS, "date"))
        return d.strftime("%Y-%m-%d" if value[4] == "-" else "%d/%m/%Y" if "/" in value else "%d.%m.%Y")

    def _month_first(self, value: str) -> str | None:
        day = _day(f"{value[3:5]}/{value[:2]}/{value[6:]}")
        while day is not None:
            day = _FIRST_DAY + self.move(day - _FIRST_DAY, _DAYS, "date")
            d = datetime.date.fromordinal(day)
            if d.day > 12:
                return d.strftime("%m/%d/%Y")
        return None

    def _email(self, value: str) -> str:
        name, host = value.split("@", 1)
        return f"{self._alike(name, 'email')}@{host}"

    def _alike(self, text: str, tweak: str) -> str:
        """Letters, marks and digits permuted among their like, as one number."""
        alphabets = [_alphabet(c) for c in text]
        x, n = 0, 1
        for c, letters in zip(text, alphabets):
            x, n = x * len(letters) + letters.index(c), n * len(letters)
        x, out = self.move(x, n, f"{tweak}/{''.join(letters[0] for letters in alphabets)}"), []
        for letters in reversed(alphabets):
            x, r = divmod(x, len(letters))
            out.append(letters[r])
        return "".join(reversed(out))

    def _secret(self, value: str) -> str:
        n = len(value)
        new = f"{self.move(int(value, 16), 16**n, 'secret'):0{n}x}"
        return new.upper() if value == value.upper() else new


def task(key: bytes, undo: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, undo)
        may = re.compile(r"[0-9@]")
        memo: dict[str, tuple[str, tuple[str, ...]]] = {}
        for batch in batches:
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                found = dict.fromkeys(KINDS, 0)
                if text and may.search(text):

                    def one(m: re.Match) -> str:
                        if m.group() not in memo:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[m.group()] = names.replaced(m)
                        new, kinds = memo[m.group()]
                        for kind in kinds:
                            found[kind] += 1
                        return new

                    text = PATTERN.sub(one, text)
                texts.append(text)
                counts.append(list(found.values()))
            columns = [pa.array(c, pa.int32()) for c in zip(*counts)] if counts else [pa.array([], pa.int32()) for _ in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), *columns], names=["doc_id", "text", *KINDS])

    return run


def pseudonymized(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values of each kind."""
    return only(docs, "doc_id", "text").mapInArrow(task(key, undo), "doc_id long, text string, " + ", ".join(f"{k} int" for k in KINDS))


def counted(found: DataFrame) -> DataFrame:
    """``pseudonymized`` with the number of values of all kinds, n_values."""
    total = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    return found.withColumn("n_values", total)
