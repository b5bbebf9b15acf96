"""Repair text extracted from scanned pages.

Page furniture (running headers and footers, page numbers) is found at the edges of pages:
by its form, by its likeness to the title, or because its folded form recurs on other pages
of the file. Words broken across lines and pages are joined again. Lower-case words that
the vocabulary does not know are looked up by a Levenshtein automaton that walks the trie
of the vocabulary, which gives every word within the distance; candidates are ranked by the
cost of the misreadings, their frequency and the words beside them.

The vocabulary is counted over all files that were parsed cleanly, with the words of the
scans used only where there are none. The words to look up are distinct words, spread over
the cluster; the vocabulary meets them in shards of bounded size, so it may grow.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.runtime import staged

IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif")
HYPHENS = "-‐‑¬­"
EDGE = ".,;:!?()[]{}<>\"'“”‘’«»…|~#*=_" + HYPHENS + "–—"
SHARD_WORDS = 200_000
PART_WORDS = 20_000
BROADCAST_ROWS = 200_000

# Usual misreadings, right characters and what they are read as.
MISREAD = (
    ("o", "0"), ("a", "o"), ("e", "c"), ("c", "e"), ("i", "l"), ("i", "1"), ("l", "1"), ("l", "|"), ("l", "i"), ("l", "I"), ("s", "5"),
    ("b", "6"), ("h", "b"), ("t", "f"), ("f", "t"), ("g", "9"), ("g", "q"), ("v", "y"), ("z", "2"), ("d", "cl"), ("cl", "d"), ("m", "rn"),
    ("rn", "m"), ("n", "ri"), ("in", "m"), ("u", "ii"), ("w", "vv"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("n", "u"), ("u", "n"),
)
CHEAP, DEAR = 0.3, 1.0
MARKS = {"internal", "draft", "confidential"}
ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")

LINE = T.StructType([
    T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("broken", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("at_end", T.BooleanType()),
    T.StructField("at_start", T.BooleanType()), T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("opens", T.BooleanType()), T.StructField("full", T.BooleanType()),
])
FOUND = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("right", T.StringType()),
    T.StructField("cost", T.DoubleType()), T.StructField("n", T.LongType()),
])


@lru_cache(100_000)
def fold(line: str) -> str:
    """A form of a line in which usual misreadings make no difference; letters only."""
    s = unicodedata.normalize("NFKD", line).casefold()
    for a, b in (("rn", "m"), ("in", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("ii", "u")):
        s = s.replace(a, b)
    s = s.translate(str.maketrans("0aec1i|!tfj56h9qy2", "oooollllllls" + "bbggvz"))
    return re.sub(r"[\W\d_]", "", s)


def _number(s: str) -> bool:
    """Digits, or what digits are misread as, with at least one digit; or a Roman numeral."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c))
    if re.fullmatch(r"[0-9OoIl|SsBbGgZzq]{1,5}", s) and (re.search(r"\d", s) or s in ("O", "S", "B", "Z")):
        return True
    low = s.lower().replace("1", "i").replace("|", "i").replace("y", "v")
    return bool(low) and len(low) <= 10 and (bool(ROMAN.fullmatch(low)) or bool(ROMAN.fullmatch(re.sub("^i(?=[xlc])", "l", low))))


def is_page_number(line: str) -> bool:
    s = line.strip()
    if not s or s[-1] in ".,;:?!":
        return False
    inner = s.strip(" -–—~[]()|.*")
    words = inner.split()
    if len(words) > 1 and (words[0] == "หน้า" or fold(words[0]) in (fold("page"), fold("seite"))):
        inner = " ".join(words[1:])
    parts = re.split(r"\s*/\s*|\s+of\s+|\s+0f\s+|\s+จาก\s+", inner)
    return len(parts) <= 2 and all(_number(p) for p in parts)


def without_number(line: str) -> tuple[str, bool]:
    """A header without the page number that stands apart from it."""
    s = line.strip()
    m = re.fullmatch(r"(\S{1,6})\s{3,}(\S.*)", s)
    if m and _number(m[1].strip("-[]().|")):
        return m[2], True
    m = re.fullmatch(r"(.*\S)\s{3,}(\S{1,6})", s)
    if m and _number(m[2].strip("-[]().|")):
        return m[1], True
    return s, False


def alike(a: str, b: str) -> bool:
    return bool(a) and bool(b) and (a == b or (abs(len(a) - len(b)) <= 3 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85))


def edge_lines(content: str) -> tuple[list[int], list[int]]:
    """Numbers of the first two and, inward, of the last three lines with text."""
    full = [i for i, x in enumerate(content.split("\n")) if x.strip()]
    return full[:2], full[::-1][:3]


def edge_keys(content: str | None) -> list[str]:
    """Folded lines at the edges of a page that could be furniture: long enough, no sentence end."""
    if not content:
        return []
    lines = content.split("\n")
    top, bottom = edge_lines(content)
    keys = {("t" if i in top else "b") + fold(without_number(lines[i])[0]) for i in {*top, *bottom[:2]} if lines[i].strip()[-1] not in ".;,?!:"}
    return sorted(k for k in keys if len(k) > 6)


GRAM = 4  # lines that are alike (at least 0.85 in common) share a run of four characters


@lru_cache(512)
def gram_index(repeated: tuple[str, ...]) -> dict[str, list[str]]:
    """The longer repeated keys of a file by every run of four characters, the side of the page first."""
    index: dict[str, list[str]] = {}
    for k in repeated:
        if len(k) > 8:
            for g in {k[0] + k[i : i + GRAM] for i in range(1, len(k) - GRAM + 1)}:
                index.setdefault(g, []).append(k)
    return index


def known_line(key: str, side: str, repeated: tuple[str, ...]) -> bool:
    """The key recurs in the file, or is like one that does; only keys with a run in common are compared."""
    if len(key) > 5 and side + key in repeated:
        return True
    index = gram_index(repeated)
    near = {k for i in range(len(key) - GRAM + 1) for k in index.get(side + key[i : i + GRAM], ())}
    return any(alike(k[1:], key) for k in near)


def is_furniture(line: str, at_top: bool, title: str | None, repeated: tuple[str, ...]) -> bool:
    if is_page_number(line):
        return True
    text, numbered = without_number(line)
    if text and text[-1] in ".;,?!:":
        return False
    key = fold(text)
    if title:
        name = fold(title)
        if len(name) > 5 and any(alike(fold(p), name) for p in [text, *re.split(r"\||\s-\s", text)]):
            return True
    if numbered or known_line(key, "t" if at_top else "b", repeated):
        return True
    words = text.split()
    return not at_top and 1 < len(words) <= 6 and words[0][:1].isupper() and any(fold(words[-1]) == fold(m) for m in MARKS)


def page_lines(content: str | None, title: str | None, repeated: list[str] | None) -> list[tuple]:
    """The lines of a page with their kind, broken words and whole words (see ``LINE``)."""
    if not content:
        return []
    lines, again = content.split("\n"), tuple(repeated if repeated is not None else ())
    top, bottom = edge_lines(content)
    furniture = set()
    for side, at_top in ((top, True), (bottom, False)):
        side = [i for i in side if i not in furniture]
        known = [n for n, i in enumerate(side) if is_furniture(lines[i], at_top, title, again)]
        # what lies outside of a header or footer is furniture too; page numbers stand outermost
        known = [n for n in known if n == 0 or not at_top or not is_page_number(lines[side[n]])]
        furniture.update(side[: max(known, default=-1) + 1])
    body = [i for i, x in enumerate(lines) if x.strip() and i not in furniture]
    out = [(i, "furniture", lines[i].strip(), None, None, False, False, [], False, False) for i in sorted(furniture)]
    carried = False
    widest = max((len(lines[i].rstrip()) for i in body), default=0)
    for n, i in enumerate(body):
        words = lines[i].split()
        last = words[-1]
        broken = None
        if len(last) > 1 and last[-1] in HYPHENS and last.strip(EDGE):
            broken = last[:-1].lstrip(EDGE)
        rest = None
        if broken and n + 1 < len(body):
            rest = lines[body[n + 1]].split()[0].strip(EDGE)
        whole = words[1 if carried else 0 : len(words) - 1 if broken else None]
        out.append((
            i, "body", lines[i].strip(), broken, rest, n + 1 == len(body), n == 0, [w.strip(EDGE.replace("|", "")) for w in whole],
            lines[i][:1] in (" ", "\t") or (n > 0 and any(not lines[j].strip() for j in range(body[n - 1] + 1, i))),
            len(lines[i].rstrip()) >= 0.75 * widest,
        ))
        carried = bool(broken)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _edge_keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series([edge_keys(t) for t in s])


@F.pandas_udf(T.ArrayType(LINE))
def _page_lines(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    names = LINE.fieldNames()
    for contents, titles, repeated in batches:
        yield pd.Series([
            [dict(zip(names, row, strict=True)) for row in page_lines(c, t, r)]
            for c, t, r in zip(contents, titles, repeated, strict=True)
        ])


def pages(chunks: DataFrame) -> DataFrame:
    """Latest row of every chunk with ``scanned``: whether its file is a scan.

    A file is a scan if any of its chunks names OCR as the extraction, counts pages, or is
    an image.
    """
    cols = ["chunk_id", "document_id", "chunk_index", "content", "title", "document_type", "metadata"]
    rows = chunks.where(F.col("chunk_id").isNotNull() & F.col("document_id").isNotNull())
    latest = rows.groupBy("chunk_id").agg(F.max(F.struct("ingested_at", *cols[1:])).alias("r")).select("chunk_id", *[f"r.{c}" for c in cols[1:]])
    signs = (
        (F.get_json_object("metadata", "$.extraction_method") == "OCR")
        | F.get_json_object("metadata", "$.page_count").isNotNull()
        | F.lower("document_type").isin(*IMAGES)
    )
    files = rows.groupBy("document_id").agg(F.max(F.coalesce(signs, F.lit(False))).alias("scanned"), F.max("title").alias("file_title"))
    return latest.drop("title", "metadata", "document_type").join(files, "document_id")


def read_lines(page: DataFrame) -> DataFrame:
    """(chunk_id, document_id, chunk_index, line fields ...): the lines of scanned pages."""
    keys = page.select("document_id", "chunk_index", F.explode(_edge_keys("content")).alias("key")).distinct()
    again = keys.groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.groupBy("document_id").agg(F.array_sort(F.collect_list("key")).alias("repeated"))
    page = page.join(again, "document_id", "left")
    return page.select(
        "chunk_id", "document_id", "chunk_index", F.explode(_page_lines("content", "file_title", "repeated")).alias("l")
    ).select("chunk_id", "document_id", "chunk_index", "l.*")


def next_starts(lines: DataFrame) -> DataFrame:
    """(document_id, chunk_index, follows): the first word of the next page that has text."""
    starts = lines.where("at_start").select("document_id", "chunk_index", F.trim(F.split("text", r"\s+")[0]).alias("first"))
    w = Window.partitionBy("document_id", F.floor(F.col("chunk_index") / 512)).orderBy("chunk_index")
    inner = starts.withColumn("follows", F.lead("first").over(w))
    # the last page of a bucket is followed by the first page of the next bucket with text
    heads = starts.groupBy("document_id", F.floor(F.col("chunk_index") / 512).alias("bucket")).agg(F.min(F.struct("chunk_index", "first")).alias("h"))
    heads = heads.withColumn("after", F.lead("h.first").over(Window.partitionBy("document_id").orderBy("bucket")))
    return (
        inner.withColumn("bucket", F.floor(F.col("chunk_index") / 512)).join(heads, ["document_id", "bucket"])
        .select("document_id", "chunk_index", F.coalesce("follows", "after").alias("follows"))
    )


def is_lower(c: str = "word"):
    """A word to look up: a letter in it, no capital at its start, no Thai."""
    return F.col(c).rlike(r"\p{L}") & ~F.col(c).rlike(r"^\p{Lu}|[\p{Lu}]{2}|\p{IsThai}")


def clean_words(page: DataFrame) -> DataFrame:
    """(word, n): lower-case words of files that are not scans."""
    words = page.where("not scanned").select(F.explode(F.split("content", r"\s+")).alias("word"))
    words = words.select(F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word"))
    return words.where(F.col("word").rlike(r"^\p{Ll}[\p{Ll}\p{M}]*(-\p{Ll}+)*$") & ~F.col("word").rlike(r"\p{IsThai}")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Automaton:
    """The Levenshtein automaton of all words at once, for one greatest distance.

    After j letters of a candidate only the distances to the prefixes of j - most to j + most
    letters of the word can be within the limit. A state holds these 2 * most + 1 distances,
    greater ones as most + 1; its input says which letters of the word under the band equal
    the next letter of the candidate. So states and inputs know neither the word nor the
    place in it, there are few of both, and each transition is computed once for all words.
    """

    def __init__(self, most: int) -> None:
        self.most, self.band = most, (1 << 2 * most + 1) - 1
        self.start = tuple(min(abs(i), most + 1) if i >= 0 else most + 1 for i in range(-most, most + 1))
        self.table: dict[tuple[tuple[int, ...], int], tuple[int, ...] | None] = {}

    def step(self, state: tuple[int, ...], equal: int) -> tuple[int, ...] | None:
        """The state after one more letter, None if nothing is within the limit any more."""
        try:
            return self.table[state, equal]
        except KeyError:
            row: list[int] = []
            for i, d in enumerate(state):
                best = d + (not equal >> i & 1)
                if i + 1 < len(state):
                    best = min(best, state[i + 1] + 1)
                if row:
                    best = min(best, row[-1] + 1)
                row.append(min(best, self.most + 1))
            to = self.table[state, equal] = tuple(row) if min(row) <= self.most else None
            return to


@lru_cache
def automaton(most: int) -> Automaton:
    return Automaton(most)


class Trie:
    """A vocabulary as a trie, walked by a Levenshtein automaton."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.root: dict = {}
        for w, n in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = (w, n)

    def within(self, word: str, most: int) -> list[tuple[str, int]]:
        """Every word of the vocabulary at most ``most`` edits away, with its count.

        Branch and automaton go on letter by letter; a branch is left where the automaton ends.
        """
        auto = automaton(most)
        places: dict[str, int] = {}
        for i, c in enumerate(word, most):
            places[c] = places.get(c, 0) | 1 << i
        out, stack = [], [(self.root, auto.start, 0)]
        while stack:
            node, state, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    end = len(word) - depth + most
                    if 0 <= end < len(state) and state[end] <= most:
                        out.append(child)
                    continue
                to = auto.step(state, places.get(c, 0) >> depth & auto.band)
                if to is not None:
                    stack.append((child, to, depth + 1))
        return out


def reach(word: str) -> int:
    return 1 if len(word) <= 3 else 2 if len(word) <= 7 else 3


def misread_cost(right: str, read: str) -> float:
    """Least cost to read ``right`` as ``read``: usual misreadings are cheap, an accent too."""
    inf = 99.0
    d = [[inf] * (len(read) + 1) for _ in range(len(right) + 1)]
    d[0][0] = 0.0
    for i in range(len(right) + 1):
        for j in range(len(read) + 1):
            v = d[i][j]
            if v >= inf:
                continue
            if i < len(right) and j < len(read):
                a, b = right[i], read[j]
                step = 0.0 if a == b else CHEAP if unicodedata.normalize("NFD", b)[0] == a or unicodedata.normalize("NFD", a)[0] == b else DEAR
                d[i + 1][j + 1] = min(d[i + 1][j + 1], v + step)
            if i < len(right):
                d[i + 1][j] = min(d[i + 1][j], v + DEAR)
            if j < len(read):
                d[i][j + 1] = min(d[i][j + 1], v + DEAR)
            for a, b in MISREAD:
                if right.startswith(a, i) and read.startswith(b, j):
                    d[i + len(a)][j + len(b)] = min(d[i + len(a)][j + len(b)], v + CHEAP)
    return d[-1][-1]


def look_up(words: DataFrame, vocabulary: DataFrame, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """(word, right, cost, n): every vocabulary word within reach of every distinct word.

    A grid of groups: the words are split into parts, the vocabulary into shards, and each
    group builds the trie of its shard and looks up the words of its part. Nothing is
    collected or broadcast, and the parts are never merged into fewer tasks than there are.
    """
    cores = words.sparkSession.sparkContext.defaultParallelism
    shards = vocabulary.count() // shard_words + 1
    parts = max(2 * cores, words.count() // part_words + 1)
    at = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part")
    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard")
    asked = words.select("word", at, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    known = vocabulary.select(F.col("word").alias("right"), "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), shard)
    tasks = shards * parts
    asked, known = asked.repartition(tasks, "part", "shard"), known.repartition(tasks, "part", "shard")

    def find(ask: pd.DataFrame, know: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(know):
            return pd.DataFrame([], columns=FOUND.fieldNames())
        trie = Trie(list(zip(know["right"], know["n"].tolist(), strict=True)))
        rows = [(w, c, misread_cost(c, w), n) for w in ask["word"] for c, n in trie.within(w, reach(w))]
        return pd.DataFrame(rows, columns=FOUND.fieldNames())

    return asked.groupBy("part", "shard").cogroup(known.groupBy("part", "shard")).applyInPandas(find, FOUND)


def repairs(chunks: DataFrame, *, most_cost: float = 1.25, ratio: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(lines, cases) of the scanned files of ``chunks``; cases are (chunk_id, line_no, kind, word, read).

    ``chunks`` has chunk_id, document_id, chunk_index, content, title, document_type,
    metadata and ingested_at; other columns are ignored. A repeated chunk counts once, with
    its latest row. Null and blank contents, null ids, and empty tables give no rows. A
    word is corrected if its cheapest readings cost at most ``most_cost`` and the right
    word is ``ratio`` times as frequent as the word itself.
    """
    page = staged(pages(chunks), "pages")
    clean = staged(clean_words(page), "vocabulary")
    lines = staged(read_lines(page.where("scanned and content is not null")), "lines")
    body = lines.where("kind = 'body'")
    ends = body.where("at_end and broken is not null").join(next_starts(body), ["document_id", "chunk_index"])
    strip = "^[" + re.escape(EDGE) + "]+|[" + re.escape(EDGE) + "]+$"
    broken = body.where("broken is not null and rest is not null").select("chunk_id", "line_no", "broken", "rest").unionByName(
        ends.where("follows is not null").select("chunk_id", "line_no", "broken", F.regexp_replace("follows", strip, "").alias("rest"))
    ).where("rest <> ''")
    # the first word of a page that ends a word of the page before is no word of its own
    w = Window.partitionBy("document_id", "first_of").orderBy("chunk_index")
    marks = body.where("at_end or at_start").groupBy("document_id", "chunk_index").agg(
        F.max(F.when(F.col("at_end"), F.col("broken").isNotNull())).alias("open")
    )
    marks = marks.withColumn("first_of", F.floor(F.col("chunk_index") / 512))
    tails = marks.groupBy("document_id", "first_of").agg(F.max(F.struct("chunk_index", "open")).alias("t"))
    tails = tails.withColumn("before", F.lag("t.open").over(Window.partitionBy("document_id").orderBy("first_of")))
    marks = marks.withColumn("prev", F.lag("open").over(w)).join(tails, ["document_id", "first_of"])
    carried = marks.where(F.coalesce("prev", "before", F.lit(False))).select("document_id", "chunk_index", F.lit(True).alias("carried"))
    words = body.join(carried, ["document_id", "chunk_index"], "left").select(
        "chunk_id", "line_no",
        F.when(F.col("at_start") & F.col("carried"), F.expr("slice(words, 2, size(words))")).otherwise(F.col("words")).alias("words"),
    )
    words = words.select("chunk_id", "line_no", "words", F.posexplode("words").alias("place", "word")).select(
        "chunk_id", "line_no", "place", "word",
        F.lower(F.get("words", F.col("place") - 1)).alias("before"), F.lower(F.get("words", F.col("place") + 1)).alias("after"),
    )
    words = staged(words.where(is_lower()), "words")
    joined = F.concat("broken", "rest")
    hyphened = F.concat(F.col("broken"), F.lit("-"), F.col("rest"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    if clean.limit(1).count() == 0:  # nothing was parsed cleanly: the frequent words of the scans themselves
        clean = staged(counts.where("seen >= 5").select("word", F.col("seen").alias("n")), "vocabulary")
    unknown = counts.join(clean, "word", "left_anti")
    halves = broken.select(F.explode(F.array(F.lower(joined), F.lower(hyphened))).alias("word")).where(is_lower()).distinct().join(clean, "word", "left_anti")
    asked = unknown.select("word").unionByName(halves).distinct()
    found = staged(look_up(asked, clean).where(F.col("cost") <= most_cost), "found")
    # misread words, by cost, frequency and the words beside them
    pairs = words.select("before", "word").where("before is not null").groupBy("before", "word").agg(F.count(F.lit(1)).alias("m"))
    meant = found.join(unknown, "word").where((F.col("n") >= ratio * F.col("seen")) | (F.col("cost") <= 2 * CHEAP + 0.01))
    # few words are misread: up to a checked number of rows they go to the tokens, not the tokens to them
    at = words.join(F.broadcast(meant) if found.count() <= BROADCAST_ROWS else meant, "word")
    at = at.join(pairs.select("before", F.col("word").alias("right"), F.col("m").alias("m1")), ["before", "right"], "left")
    at = at.join(pairs.select(F.col("before").alias("right"), F.col("word").alias("after"), F.col("m").alias("m2")), ["right", "after"], "left")
    score = -8 * F.col("cost") + F.log1p("n") + F.log1p(F.coalesce("m1", F.lit(0))) + F.log1p(F.coalesce("m2", F.lit(0)))
    misread = at.groupBy("chunk_id", "line_no", "place", "word").agg(F.max(F.struct(score.alias("score"), "right")).alias("b"))
    misread = misread.select("chunk_id", "line_no", F.lit("misread").alias("kind"), F.col("b.right").alias("word"), F.col("word").alias("read"))
    # broken words: the form that the vocabulary knows, else the nearest known one, else joined
    best = found.groupBy("word").agg(F.min(F.struct("cost", (-F.col("n")).alias("rare"), "right")).alias("b")).select("word", F.col("b.right").alias("near"), F.col("b.cost").alias("cost"))
    b = broken.withColumn("j", F.lower(joined)).withColumn("h", F.lower(hyphened))
    b = b.join(clean.select(F.col("word").alias("j"), F.col("n").alias("nj")), "j", "left").join(clean.select(F.col("word").alias("h"), F.col("n").alias("nh")), "h", "left")
    b = b.join(best.select(F.col("word").alias("j"), F.col("near").alias("j_near"), F.col("cost").alias("j_cost")), "j", "left")
    b = b.join(best.select(F.col("word").alias("h"), F.col("near").alias("h_near"), F.col("cost").alias("h_cost")), "h", "left")
    lower = ~F.col("broken").rlike(r"^\p{Lu}")
    whole = (
        F.when(F.col("nj").isNotNull() & (F.col("nj") >= F.coalesce("nh", F.lit(0))), joined)
        .when(F.col("nh").isNotNull(), hyphened)
        .when(lower & F.col("j_near").isNotNull() & (F.col("j_cost") <= F.coalesce("h_cost", F.lit(9.0))), F.col("j_near"))
        .when(lower & F.col("h_near").isNotNull(), F.col("h_near"))
        .otherwise(joined)
    )
    split = b.select("chunk_id", "line_no", F.lit("broken").alias("kind"), whole.alias("word"), F.col("broken").alias("read"))
    plain = lines.where("kind = 'furniture'").select("chunk_id", "line_no", "kind", F.lit("").alias("word"), F.col("text").alias("read"))
    return lines, plain.unionByName(split).unionByName(misread)


def paragraph_numbers(lines: DataFrame) -> DataFrame:
    """Body lines with ``paragraph``: their number along the whole document.

    A line opens a paragraph if it is indented or follows a blank line. The first line of a
    page goes on with the page before if that page ends inside of a word or a sentence, or
    in a full line, or if it begins with a small letter. Pages are numbered first, by one row
    each, so no document is sorted line by line in one place.
    """
    body = lines.where("kind = 'body'")
    ends = body.where("at_start or at_end").groupBy("document_id", "chunk_index").agg(
        F.max(F.when(F.col("at_start"), F.struct("text", "opens"))).alias("first"),
        F.max(F.when(F.col("at_end"), F.struct("text", "full", F.col("broken").isNotNull().alias("broken")))).alias("last"),
    )
    inside = body.where("opens and not at_start").groupBy("document_id", "chunk_index").agg(F.count(F.lit(1)).alias("inner"))
    before = F.lag("last").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    page = ends.join(inside, ["document_id", "chunk_index"], "left").withColumn("b", before)
    done = F.col("b.text").rlike(r"[.!?:]['\"”’)]*$") & ~F.col("b.full") & ~F.col("first.text").rlike(r"^\p{Ll}")
    new = F.col("b").isNull() | (~F.col("b.broken") & (F.col("first.opens") | done))
    page = page.select("document_id", "chunk_index", new.cast("int").alias("new"), F.coalesce("inner", F.lit(0)).alias("inner"))
    total = F.sum(F.col("new") + F.col("inner")).over(Window.partitionBy("document_id").orderBy("chunk_index"))
    page = page.withColumn("first_number", total - F.col("inner") - 1).select("document_id", "chunk_index", "first_number")
    within = F.sum((F.col("opens") & ~F.col("at_start")).cast("int")).over(Window.partitionBy("document_id", "chunk_index").orderBy("line_no"))
    return body.join(page, ["document_id", "chunk_index"]).withColumn("paragraph", F.col("first_number") + within).drop("first_number")


def reflowed(rows: list[dict]) -> str:
    """One text of the lines of a paragraph, with its repairs; the end of a broken word is not repeated."""
    parts: list[str] = []
    taken = False
    for r in rows:
        words = r["text"].split()[1 if taken else 0 :]
        for f in r["fix"] if r["fix"] is not None else ():
            words = [w.replace(f["read"], f["word"]) if w.strip(EDGE.replace("|", "")) == f["read"] else w for w in words]
        taken = r["word"] is not None
        if taken and words:
            words[-1] = r["word"]
        parts += words
    return " ".join(parts)


def repaired_paragraphs(chunks: DataFrame, **options) -> DataFrame:
    """(document_id, paragraph, first_page, last_page, text): the continuous paragraphs of every scanned document.

    Furniture is gone, words broken across lines or pages are whole, misread words are right,
    and a paragraph that runs over a page end is one row. Pages are chunk_index. Treats null,
    blank and repeated input as ``repairs`` does.
    """
    lines, cases = repairs(chunks, **options)
    cases = staged(cases, "cases")
    fix = cases.where("kind = 'misread'").groupBy("chunk_id", "line_no").agg(F.collect_set(F.struct("read", "word")).alias("fix"))
    cut = cases.where("kind = 'broken'").select("chunk_id", "line_no", F.col("read").alias("part"), "word")
    rows = paragraph_numbers(lines).join(fix, ["chunk_id", "line_no"], "left").join(cut, ["chunk_id", "line_no"], "left")
    whole = rows.groupBy("document_id", "paragraph").agg(
        F.min("chunk_index").alias("first_page"), F.max("chunk_index").alias("last_page"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "line_no", "text", "part", "word", "fix"))).alias("lines"),
    )

    @F.pandas_udf(T.StringType())
    def reflow(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([reflowed(x) for x in s], dtype=object)

    text = whole.select("document_id", F.col("paragraph").cast("long").alias("paragraph"), "first_page", "last_page", reflow("lines").alias("text"))
    return text.where("text <> ''")


def repaired_pages(chunks: DataFrame, **options) -> DataFrame:
    """(document_id, chunk_id, chunk_index, continues, text): every scanned page as continuous text.

    Furniture is gone, words broken inside the page or at its end are whole, misread words
    are right; the text of a page begins after a word that the page before has taken over.
    Lines are joined by blanks, paragraphs (blank or indented lines) by line breaks;
    ``continues`` tells that the page goes on with the sentence of the page before.
    """
    lines, cases = repairs(chunks, **options)
    cases = staged(cases, "cases")
    fix = cases.where("kind = 'misread'").groupBy("chunk_id", "line_no").agg(F.collect_set(F.struct("read", "word")).alias("fix"))
    cut = cases.where("kind = 'broken'").select("chunk_id", "line_no", F.col("read").alias("part"), "word")
    rows = lines.where("kind = 'body'").join(fix, ["chunk_id", "line_no"], "left").join(cut, ["chunk_id", "line_no"], "left")
    page = rows.groupBy("document_id", "chunk_id", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text", "part", "word", "fix"))).alias("lines")
    )

    @F.pandas_udf("continues boolean, text string")
    def reflow(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for page_rows in s:
                parts: list[str] = []
                taken, previous = False, None
                for r in page_rows:
                    words = r["text"].split()
                    if taken:
                        words = words[1:]
                    for f in r["fix"] if r["fix"] is not None else ():
                        words = [w.replace(f["read"], f["word"]) if w.strip(EDGE.replace("|", "")) == f["read"] else w for w in words]
                    taken = r["word"] is not None
                    if taken and words:
                        words[-1] = r["word"]
                    gap = previous is not None and r["line_no"] > previous + 1
                    parts += (["\n"] if gap else []) + words
                    previous = r["line_no"]
                text = re.sub(r" ?\n ?", "\n", " ".join(parts))
                out.append((bool(text) and text[0].islower(), text))
            yield pd.DataFrame(out, columns=["continues", "text"])

    return page.select("document_id", "chunk_id", "chunk_index", reflow("lines").alias("p")).select("document_id", "chunk_id", "chunk_index", "p.*")
