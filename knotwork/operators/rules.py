"""Matchers of the rule-based mention types.

A text is read twice: once for runs of digits, once for capitalised words. Every matcher
starts from one of these, from an ``@`` or from a scheme, and reads on by small steps, so no
pattern is tried at every character. White space, digits and word characters are those of
Unicode. Matches of one type never overlap; the leftmost one wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# Words that the forms accept.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
ORDINALS = ("st", "nd", "rd", "th")
HALVES = ("AM", "PM", "am", "pm")
CURRENCIES = ("dollars", "baht", "USD", "THB")
LEGAL_FORMS = ("Inc", "LLC", "Corp", "Company", "Co", "Ltd")

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM = frozenset(LETTERS + "0123456789")
ALPHA = frozenset(LETTERS)
LOCAL = ALNUM | frozenset("._%+-")
HOST = ALNUM | frozenset(".-")
SITE = ALNUM | frozenset("@:%._+~#=-")
PATH = SITE | frozenset("()?&/")
DIGITS = re.compile(r"\d+")
CAPITALISED = re.compile(r"\b[A-Z][A-Za-z0-9]*\b")
Span = tuple[int, int]


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def char(t: str, i: int) -> str:
    """The character at ``i``, or a blank outside of the text."""
    return t[i] if 0 <= i < len(t) else " "


def after_space(t: str, i: int, least: int = 1) -> int:
    """The end of the white space at ``i``, or -1 if it is shorter than ``least``."""
    j = i
    while j < len(t) and t[j].isspace():
        j += 1
    return j if j - i >= least else -1


def word_at(t: str, i: int) -> str:
    j = i
    while j < len(t) and is_word(t[j]):
        j += 1
    return t[i:j]


def run_of(t: str, i: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters that begins at ``i``."""
    while i < len(t) and t[i] in allowed:
        i += 1
    return i


def digits_at(t: str, i: int) -> int:
    """The end of the run of digits that begins at ``i``."""
    while i < len(t) and t[i].isdecimal():
        i += 1
    return i


def ends_word(t: str, i: int) -> bool:
    """A word ends before ``i``: a word character before it, none at it."""
    return is_word(char(t, i - 1)) and not is_word(char(t, i))


class Scan:
    """A text with its runs of digits and its chains of capitalised words."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.digits: list[Span] = [m.span() for m in DIGITS.finditer(text)]
        self.chains: list[list[Span]] = []
        end = -1
        for m in CAPITALISED.finditer(text):
            if self.chains and after_space(text, end) == m.start():
                self.chains[-1].append(m.span())
            else:
                self.chains.append([m.span()])
            end = m.end()


def apart(spans: Iterator[Span]) -> Iterator[Span]:
    """The spans that begin after the end of the one taken before."""
    free = 0
    for a, b in spans:
        if a >= free:
            yield a, b
            free = b


def persons(s: Scan) -> Iterator[Span]:
    """Two neighbouring words of one capital and then lower-case letters."""
    for chain in s.chains:
        i = 0
        while i + 1 < len(chain):
            two = [s.text[a:b] for a, b in chain[i : i + 2]]
            if all(len(w) > 1 and w[1:].isalpha() and w[1:].islower() for w in two):
                yield chain[i][0], chain[i + 1][1]
                i += 2
            else:
                i += 1


def organisations(s: Scan) -> Iterator[Span]:
    """Two or more capitalised words and a legal form; the last form of the chain ends it."""
    for chain in s.chains:
        forms = [i for i, (a, b) in enumerate(chain) if i >= 2 and s.text[a:b] in LEGAL_FORMS]
        if forms:
            yield chain[0][0], chain[forms[-1]][1]


def written_dates(s: Scan) -> Iterator[Span]:
    """Month, day with an optional ordinal ending, comma, year of four digits."""
    t = s.text
    for chain in s.chains:
        for a, b in chain:
            if t[a:b] not in MONTHS or (i := after_space(t, b)) < 0:
                continue
            j = digits_at(t, i)
            if not 1 <= j - i <= 2:
                continue
            j += 2 if t[j : j + 2] in ORDINALS else 0
            if char(t, j) != "," or (k := after_space(t, j + 1)) < 0:
                continue
            if digits_at(t, k) == k + 4 and ends_word(t, k + 4):
                yield a, k + 4


def slashed_dates(s: Scan) -> Iterator[Span]:
    t = s.text
    for a, b in s.digits:
        if b - a > 2 or is_word(char(t, a - 1)) or char(t, b) != "/":
            continue
        c = digits_at(t, b + 1)
        if not 1 <= c - b - 1 <= 2 or char(t, c) != "/":
            continue
        d = digits_at(t, c + 1)
        if 2 <= d - c - 1 <= 4 and ends_word(t, d):
            yield a, d


def dates(s: Scan) -> Iterator[Span]:
    return iter(sorted([*written_dates(s), *slashed_dates(s)]))


def times(s: Scan) -> Iterator[Span]:
    """Hours, colon, two digits, and an optional half of the day; blanks after the minutes alone do not belong to it."""
    t = s.text
    for a, b in s.digits:
        if b - a > 2 or is_word(char(t, a - 1)) or char(t, b) != ":" or digits_at(t, b + 1) < b + 3:
            continue
        minutes = b + 3
        half = after_space(t, minutes, 0)
        if word_at(t, half) in HALVES:
            yield a, half + 2
        elif ends_word(t, minutes):
            yield a, minutes


def amount(t: str, i: int) -> int:
    """The end of a number with optional comma groups and decimals that begins at ``i``."""
    j = digits_at(t, i)
    while char(t, j) == "," and digits_at(t, j + 1) > j + 1:
        j = digits_at(t, j + 1)
    if char(t, j) == "." and digits_at(t, j + 1) > j + 1:
        j = digits_at(t, j + 1)
    return j


def sums(s: Scan) -> Iterator[Span]:
    """A number after a dollar sign or before a currency word."""
    t = s.text
    for a, _ in s.digits:
        j = amount(t, a)
        if char(t, a - 1) == "$":
            yield a - 1, j
        elif (k := after_space(t, j)) >= 0 and (w := word_at(t, k)) in CURRENCIES:
            yield a, k + len(w)


def addresses(s: Scan) -> Iterator[Span]:
    """local@domain.tld, from every ``@``; the longest domain counts."""
    t, at = s.text, -1
    while (at := t.find("@", at + 1)) >= 0:
        a = at
        while a > 0 and t[a - 1] in LOCAL:
            a -= 1
        # the first word character that has none before it
        while a < at and not (is_word(t[a]) and not is_word(char(t, a - 1))):
            a += 1
        end = run_of(t, at + 1, HOST)
        dots = [i for i in range(end - 1, at + 1, -1) if t[i] == "."]
        for i in dots if a < at else ():
            k = run_of(t, i + 1, ALPHA)
            if k - i > 2 and ends_word(t, k):
                yield a, k
                break


def telephone(t: str, i: int) -> int:
    """The end of a number that begins at ``i`` (after a plus sign), or -1.

    An optional country code of one to three digits, three digits in optional parentheses,
    three and four digits; single separators may stand between the groups.
    """
    def separator(j: int) -> int:
        return j + 1 if char(t, j) in "-." or (j < len(t) and t[j].isspace()) else j

    def rest(j: int) -> int:
        j += char(t, j) == "("
        for n, size in enumerate((3, 3, 4)):
            if digits_at(t, j) < j + size:
                return -1
            j += size
            if n == 0:
                j += char(t, j) == ")"
            if n < 2:
                j = separator(j)
        return j if ends_word(t, j) else -1

    for code in (3, 2, 1, 0):
        if digits_at(t, i) >= i + code and (j := rest(separator(i + code) if code else i)) > 0:
            return j
    return -1


def telephones(s: Scan) -> Iterator[Span]:
    """Telephone numbers; a plus sign and an opening parenthesis before the digits belong to them."""
    t = s.text
    for a, _ in s.digits:
        if is_word(char(t, a - 1)):
            continue
        start = a - 1 if char(t, a - 1) == "(" else a
        plus = start - 1 if char(t, start - 1) == "+" else start
        end = telephone(t, start)
        if end > 0:
            yield plus, end


def links(s: Scan) -> Iterator[Span]:
    """http or https, a site of up to 256 characters, a dot, one to six letters, digits or parentheses, and a path."""
    t, i = s.text, -1
    while (i := t.find("http", i + 1)) >= 0:
        j = i + 4 + (char(t, i + 4) == "s")
        if t[j : j + 3] != "://":
            continue
        j += 3
        site = run_of(t, j, SITE)
        longest = 256 + 4 * t.startswith("www.", j)
        dots = [d for d in range(j + 1, min(site, j + longest + 1)) if t[d] == "."]
        if any(_boundary_within(t, d + 1, 6) for d in dots):
            yield i, run_of(t, j, PATH)


def _boundary_within(t: str, i: int, most: int) -> bool:
    """A word boundary after one to ``most`` letters, digits or parentheses from ``i`` on."""
    for j in range(i, i + most):
        c = char(t, j)
        if c not in ALNUM and c not in "()":
            return False
        if is_word(c) != is_word(char(t, j + 1)):
            return True
    return False


MATCHERS: dict[str, Callable[[Scan], Iterator[Span]]] = {
    "DATE": dates, "TIME": times, "MONEY": sums, "PERSON": persons, "ORGANIZATION": organisations,
    "EMAIL": addresses, "PHONE": telephones, "URL": links,
}


def find_all(text: str, types: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(type, start, end) of every match of the requested types in a text."""
    s = Scan(text)
    return [(k, a, b) for k in types if k in MATCHERS for a, b in apart(MATCHERS[k](s))]
