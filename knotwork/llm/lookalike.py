"""One consistent form for texts that look alike but differ in their characters.

A text is normalised for compatibility, ignorable characters are deleted, kinds of space
and hyphen are unified and Thai marks ordered. What remains ambiguous is a lattice: every
letter or sequence of letters that looks like another stands for its whole class. A Viterbi
search spells every token with as few changes of script as possible and, among those, with
the greatest character bigram score, counted over all texts. The lattice depends only on
how the token looks, so texts that read alike get the same form.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.runtime import staged

# Letters that look like Latin ones, each line aligned with its Latin twins.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXGQWaesijopcyxhdqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABEZHIKMNOPTYXova")
ARMENIAN = ("օսհո", "ouhn")
LATIN = ("ɑɡ", "ag")
# Sequences that look like one letter.
SEQUENCES = (("rn", "m"), ("vv", "w"), ("VV", "W"), ("เเ", "แ"))
# Other single characters that look alike (hyphens, the Thai long vowel sign).
OTHERS = {"‐": "-", "‑": "-", "ๅ": "า"}

# Code points that are never shown (default ignorable).
IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]+"
)
SPACES = re.compile("[   -   　]")
THAI_MARKS = re.compile("[ัิ-ฺ็-๎]{2,}")
TWINS = {ord(a): b for alike, latin in (CYRILLIC, GREEK, ARMENIAN, LATIN) for a, b in zip(alike, latin, strict=True)}
MARKS = "".join(map(chr, range(0x300, 0x370)))
LETTERS = 0x590  # Latin, Greek, Cyrillic and Armenian letters lie below
TOKEN = re.compile("([A-Za-zÀ-ɏɐ-ʯͰ-֏]+)")
SWITCH = 50.0  # cost of a change of script inside a token, above any bigram score


def compatible(text: str) -> str:
    """Compatibility form without ignorable characters, with plain spaces and ordered Thai marks."""
    if text.isascii():
        return text
    s = unicodedata.normalize("NFKC", IGNORABLE.sub("", text))
    return ordered_marks(SPACES.sub(" ", IGNORABLE.sub("", s)))


def ordered_marks(s: str) -> str:
    return THAI_MARKS.sub(lambda m: "".join(sorted(m.group())), s)


def single_classes(text: str) -> str:
    """The compatible form with every look-alike letter replaced by the name of its class."""
    s = compatible(text)
    if s.isascii() or not LOOKS.special.search(s):
        return s
    return ordered_marks(unicodedata.normalize("NFC", s.translate(LOOKS.single)))


def joined_sequences(s: str) -> str:
    for sequence, one in SEQUENCES:
        s = s.replace(sequence, one)
    return s


def skeleton(text: str) -> str:
    """What a text looks like: equal for texts that read alike."""
    return joined_sequences(single_classes(text))


def script(c: str) -> str:
    o = ord(c)
    return "L" if o < 0x370 else "G" if o < 0x400 else "C" if o < 0x530 else "A" if o < LETTERS else "O"


class Looks:
    """The look-alike classes of a table of twins (code point: Latin letter)."""

    def __init__(self, twins: dict[int, str]) -> None:
        self.twins = twins
        # letters that carry marks look like the Latin twin with the same marks
        marked = {
            c: unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c)).translate(twins))
            for c in range(0x370, 0x2000)
            if c not in twins and len(d := unicodedata.normalize("NFD", chr(c))) > 1 and ord(d[0]) in twins
        }
        self.single = twins | marked | {ord(a): b for a, b in OTHERS.items()}
        self.special = re.compile("[" + "".join(map(re.escape, map(chr, self.single))) + "]")
        self.alternatives = self._alternatives()
        self.scripts = {c: frozenset(script(a[0]) for a in alts) for c, alts in self.alternatives.items()}

    def _alternatives(self) -> dict[str, list[str]]:
        """For every class name the letters and sequences that stand for it."""
        out: dict[str, list[str]] = {}
        for a, b in self.twins.items():
            if a < LETTERS:
                out.setdefault(b, [b]).append(chr(a))
        for c in range(0xC0, 0x250):
            base, *marks = unicodedata.normalize("NFD", chr(c))
            if marks and base in out:
                out[chr(c)] = [unicodedata.normalize("NFC", a + "".join(marks)) for a in out[base]]
        for sequence, one in SEQUENCES:
            if one.isascii():
                out.setdefault(one, [one]).append(sequence)
        return out


LOOKS = Looks(TWINS)


def use(more: dict[int, str]) -> None:
    """Let this process know further twins; those of the fixed table stay as they are."""
    global LOOKS
    twins = more | TWINS
    if twins != LOOKS.twins:
        LOOKS = Looks(twins)


def confusable_letters(spark: SparkSession) -> dict[int, str]:
    """Letters of all scripts that the public table of confusable characters gives a single Latin letter as prototype.

    The table is that of the ICU library, which Spark brings along; it is asked once for all
    code points. Prototypes that are digits or sequences do not count.
    """
    blocks = ((0x180, 0x250), (0x250, 0x2B0), (0x370, 0x590), (0x10A0, 0x1100), (0x13A0, 0x1400), (0x1D00, 0x1D80), (0x2C00, 0x2E00), (0xA640, 0xA800), (0xAB30, 0xABC0))
    letters = [c for a, b in blocks for c in range(a, b) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFKC", chr(c)) == chr(c)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    prototypes = checker.getSkeleton("\n".join(map(chr, letters))).split("\n")
    return {c: p for c, p in zip(letters, prototypes, strict=True) if len(p) == 1 and p.isascii() and p.isalpha()}


def lattice(token: str) -> list[list[str] | tuple[str]]:
    """The spellings of every place of a skeleton token.

    If whole scripts can spell the token, only these: a path that changes script never wins.
    """
    common: frozenset[str] | None = None
    for c in token:
        own = LOOKS.scripts.get(c) or frozenset(script(c))
        common = own if common is None else common & own
        if not common:
            return [LOOKS.alternatives.get(c, (c,)) for c in token]
    return [[a for a in LOOKS.alternatives[c] if script(a[0]) in common] if c in LOOKS.alternatives else (c,) for c in token]


def best_spelling(token: str, score: dict[tuple[str, str], float], unseen: float) -> str:
    """Viterbi over the lattice of a skeleton token: fewest script changes, then best bigrams."""
    places = lattice(token)
    if all(len(p) == 1 for p in places):
        return "".join(p[0] for p in places)
    beam = [(0.0, "", " ")]  # cost, spelling, last letter
    for place in places:
        if len(place) == 1 and len(beam) == 1:
            (cost, spelt, last), c = beam[0], place[0]
            turn = SWITCH if last != " " and script(last) != script(c) else 0.0
            beam = [(cost - score.get((last, c), unseen) + turn, spelt + c, c)]
            continue
        nxt = []
        for alt in place:
            bare = alt.rstrip(MARKS)
            inner = sum(score.get((a, b), unseen) for a, b in zip(bare, bare[1:], strict=False))
            s = script(alt[0])
            nxt.append(min(
                (cost - inner - score.get((last, alt[0]), unseen) + SWITCH * (last != " " and script(last) != s), spelt + alt, bare[-1])
                for cost, spelt, last in beam
            ))
        beam = nxt
    return min((cost - score.get((last, " "), unseen), spelt) for cost, spelt, last in beam)[1]


class Speller:
    """Consistent spelling of whole texts; distinct tokens are searched once per worker."""

    def __init__(self, score: dict[tuple[str, str], float], unseen: float, keep: int = 300_000) -> None:
        self.score, self.unseen, self.keep = score, unseen, keep
        self.known: dict[str, str] = {}

    def token(self, t: str) -> str:
        s = self.known.get(t)
        if s is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            s = self.known[t] = best_spelling(t, self.score, self.unseen)
        return s

    def text(self, text: str) -> str:
        parts = TOKEN.split(skeleton(text))
        parts[1::2] = map(self.token, parts[1::2])
        return "".join(parts)


_SPELLERS: dict[str, Speller] = {}


def speller(name: str, score: dict[tuple[str, str], float], unseen: float) -> Speller:
    """The speller of one run, kept while the worker lives."""
    if name not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[name] = Speller(score, unseen)
    return _SPELLERS[name]


def bigram_counts(texts: DataFrame, column: str) -> DataFrame:
    """(pair, n): counts of neighbouring letters over all texts as written; 0 stands for the edge of a token."""
    schema = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = np.array([i if chr(i).isalpha() else 0 for i in range(LETTERS)] + [0])
        total = np.zeros(LETTERS * LETTERS, dtype=np.int64)
        for pdf in batches:
            for t in pdf[column]:
                if t:
                    cp = np.frombuffer((" " + t + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    i = letter[np.minimum(cp, LETTERS)]
                    np.add.at(total, i[:-1] * LETTERS + i[1:], 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"pair": seen.astype(np.int32), "n": total[seen]})

    return texts.select(column).mapInPandas(count, schema).where("pair > 0").groupBy("pair").agg(F.sum("n").alias("n"))


def bigram_scores(counts: DataFrame) -> tuple[dict[tuple[str, str], float], float]:
    """Logarithms of P(letter | letter before it) and the value for unseen pairs.

    The table has at most LETTERS squared rows, whatever the number of texts.
    """
    rows = [(divmod(r["pair"], LETTERS), r["n"]) for r in counts.collect()]
    before: dict[int, int] = {}
    for (a, _), n in rows:
        before[a] = before.get(a, 0) + n
    name = lambda i: chr(i) if i else " "
    scores = {(name(a), name(b)): math.log((n + 0.5) / (before[a] + 64)) for (a, b), n in sorted(rows)}
    return scores, math.log(0.5 / (sum(before.values()) + 64))


def consistent_form(docs: DataFrame, column: str = "text", out: str = "form") -> DataFrame:
    """Add ``out``: the consistent form of ``column``; null stays null, an empty text empty."""
    spark = docs.sparkSession
    scores, unseen = bigram_scores(bigram_counts(docs, column))
    shared, run = spark.sparkContext.broadcast((scores, unseen, confusable_letters(spark))), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores, unseen, more = shared.value
        use(more)
        spell = speller(run, scores, unseen)
        for s in batches:
            yield pd.Series([None if t is None else spell.text(t) for t in s], dtype=object)

    return docs.withColumn(out, form(F.col(column)))


def formed(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, f, t), staged: hashes of the consistent form and of the text itself; null keys and texts are left out."""
    rows = consistent_form(docs.select(key, column).where(F.col(key).isNotNull() & F.col(column).isNotNull()), column)
    return staged(rows.select(key, F.md5("form").alias("f"), F.md5(column).alias("t")).distinct(), "forms")


def alike_classes(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, class, n_links): the class of every document, named by its smallest key, and how many others read alike without being equal."""
    rows = formed(docs, key, column)
    per = rows.groupBy("f", "t").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("least"))
    kinds = per.groupBy("f").agg(F.sum("copies").alias("members"), F.min("least").alias("class"))
    sizes = per.join(kinds, "f").select("f", "t", "class", (F.col("members") - F.col("copies")).alias("n_links"))
    return rows.join(sizes, ["f", "t"]).select(key, "class", "n_links")


def alike_pairs(docs: DataFrame, key: str = "doc_id", column: str = "text", block: int = 256) -> DataFrame:
    """(key_a, key_b): documents whose texts are not equal but have one consistent form, key_a < key_b.

    Null keys and null texts take no part; repeated rows count once; other columns are
    ignored; an empty table gives no rows. Texts are compared by 128-bit hashes. Different
    texts of one form are paired first and their documents joined afterwards, so copies of
    one text are never paired with each other.
    """
    rows = formed(docs, key, column)
    texts = rows.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n"))
    shared = texts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("f", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = rows.join(shared.select("f"), "f", "left_semi")
    # the texts of a form are split into blocks; every pair of blocks is a key of its own
    kinds = texts.join(shared, "f").withColumn("own", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    kinds = kinds.select("f", "t", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    kinds = kinds.select("f", "t", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    one = kinds.select("f", "x", "y", F.col("t").alias("t1"), F.col("own").alias("o1"))
    two = kinds.select("f", "x", "y", F.col("t").alias("t2"), F.col("own").alias("o2"))
    two = one.join(two, ["f", "x", "y"]).where("t1 < t2 and (x = y or o1 <> o2)").select("f", "t1", "t2")
    left = members.select(F.col("f"), F.col("t").alias("t1"), F.col(key).alias("a"))
    right = members.select(F.col("f"), F.col("t").alias("t2"), F.col(key).alias("b"))
    pairs = two.join(left, ["f", "t1"]).join(right, ["f", "t2"]).where("a <> b")
    return pairs.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
