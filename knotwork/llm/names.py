"""Link the spellings under which people typed one person or organisation.

Noisy-channel attribution. Every distinct spelling is parsed into hypotheses of its parts
(surname and given name; brand and following words). Frequent full spellings are the
candidate canonical forms. Distinct main parts meet over keys with one letter left out, so
that any single typo still shares a key; spellings meet over pairs of main parts and the
first letters of their further parts. A candidate's posterior is its frequency prior times
the likelihoods of the operations that turn it into the spelling (reordering, the kinds of
typo, sound-alike spelling, nickname, initial, abbreviation); their probabilities start from
documented values and are re-estimated from the links themselves. Each spelling is attached
to its maximum posterior of higher rank, unless that it is a new name is more likely, and
the roots of these attachments are the entities.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.resolve import components
from knotwork.runtime import staged

# Type labels of one kind.
KINDS = {
    "person": "P", "per": "P",
    "organization": "O", "organisation": "O", "org": "O", "company": "O",
}
# Titles before and additions after a person's name.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "khun", "sir", "madam", "herr", "frau"}
THAI_TITLES = ("นางสาว", "คุณ", "นาย", "นาง", "ดร.", "ดร", "ศ.")
# Legal forms and fillers of organisation names.
LEGAL = {
    "co", "ltd", "limited", "inc", "llc", "gmbh", "pcl", "plc", "ag", "corp", "corporation", "company", "group",
    "and", "thailand",
}
THAI_LEGAL = re.compile("บริษัท|จำกัด|มหาชน")
# Spellings that sound alike, applied in this order.
SOUNDS = (("oo", "u"), ("ee", "i"), ("sh", "ch"), ("ph", "f"), ("ck", "k"), ("w", "v"))
HALF = 32  # main parts of more than twice this length meet over equal halves instead of shortened forms

HYPOTHESIS = T.StructType([
    T.StructField("form", T.StringType()), T.StructField("main", T.StringType()),
    T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
])
PARSED = T.StructType([
    T.StructField("hyps", T.ArrayType(HYPOTHESIS)), T.StructField("quoted", T.StringType()),
])
# Starting probabilities of the operations; re-estimated from the data. A typo is a letter left out
# (drop), added, changed or moved by one place (swap), or one in the spelling by sound (heard).
TYPOS = {"drop": 0.3, "add": 0.2, "change": 0.3, "swap": 0.15, "heard": 0.05}
OPERATIONS = {
    "form": {"plain": 0.8, "turned": 0.1, "joined": 0.05},
    "main": {"same": 0.85, "sound": 0.03} | {k: 0.1 * p for k, p in TYPOS.items()},
    "a": {"same": 0.7, "nick": 0.06, "initial": 0.08, "short": 0.03, "acronym": 0.04, "none": 0.03} | {k: 0.06 * p for k, p in TYPOS.items()},
    "b": {"same": 0.8, "short": 0.06, "acronym": 0.04, "none": 0.03} | {k: 0.06 * p for k, p in TYPOS.items()},
}
# Logarithm of the chance that a spelling which is this near to another one is a name of its own.
NEW_NAME = -13.0


def plain(text: str) -> str:
    """Letters without accents, full-width forms or invisible characters."""
    s = unicodedata.normalize("NFKD", text)
    s = "".join(c for c in s if not ("̀" <= c <= "ͯ") and unicodedata.category(c) != "Cf")
    return unicodedata.normalize("NFC", s)


def parse_person(text: str) -> tuple[list[tuple[str, str, str, str]], str | None]:
    """Hypotheses (form, surname, given name, '') and a quoted nickname."""
    s = plain(text)
    quoted = re.search(r"[\"“'‘]([^\W\d_]{2,})[\"”'’](?=\s)", s)
    s = re.sub(r"[\"“][^\"”]*[\"”]|\([^)]*\)", " ", s)
    s = re.sub(r"['’]s\b", "", s).strip()
    for t in THAI_TITLES:
        if s.startswith(t):
            s = s[len(t):].strip()
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"(?<=\w)[-‐‑](?=\w)", "", s))
    comma = re.split(r"\s*[,;]\s*", s.strip(" ,;"), maxsplit=1)

    def words(x: str) -> list[str]:
        w = re.findall(r"[^\W\d_]+", x.lower())
        while len(w) > 1 and w[0] in TITLES:
            w = w[1:]
        return w

    if len(comma) == 2 and words(comma[0]) and words(comma[1]):
        last, first = words(comma[0]), [w for w in words(comma[1]) if len(w) > 1] or words(comma[1])
        return [("plain", "".join(last), "".join(first), "")], quoted and quoted.group(1).lower()
    w = words(s)
    long = [x for x in w if len(x) > 1]
    if len(w) >= 3 and len(long) >= 2:
        w = long  # initials in the middle
    if not w:
        return [], None
    if len(w) == 1:
        return [("plain", w[0], "", "")], None
    if len(w) == 2 and len(w[1]) == 1:
        return [("plain", w[0], w[1], "")], None
    out = [("plain", "".join(w[1:]), w[0], "")]
    if len(w[0]) > 1:
        out.append(("turned", "".join(w[:-1]), w[-1], ""))
    if len(w) > 2:
        out.append(("joined", w[-1], "".join(w[:-1]), ""))
    return out, quoted and quoted.group(1).lower()


def parse_organisation(text: str) -> tuple[list[tuple[str, str, str, str]], str | None]:
    """Hypotheses (form, brand, first word, second word) of an organisation name."""
    s = re.sub(r"^\s*the\s", " ", plain(THAI_LEGAL.sub(" ", text)).replace("GmbH", " "), flags=re.IGNORECASE)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"(?<=\w)[-‐‑](?=\w)", "", s))

    def words(x: str) -> list[str]:
        x = re.sub(r"(?<![^\W\d_])((?:[^\W\d_]\.){2,})", lambda m: m.group().replace(".", ""), x)
        return [w for w in re.findall(r"[^\W\d_]+", x.lower()) if w not in LEGAL]

    inside = [words(p) for p in re.findall(r"\(([^)]*)\)", s)]
    w = words(re.sub(r"\([^)]*\)", " ", s))
    inside = [p for p in inside if len(p) == 1 and p[0] != "".join(x[0] for x in w)]
    if not w:
        return [("plain", p[0], "", "") for p in inside[:1]], None
    if inside and len(w) >= 1 and len(inside[0][0]) > 4:
        return [("plain", inside[0][0], w[0], w[1] if len(w) > 1 else "")], None
    if len(w) == 1:
        return [("plain", w[0], "", "")], None
    if len(w) == 2:
        return [("plain", w[0], w[1], ""), ("turned", w[1], w[0], "")], None
    if len(w) == 3:
        return [("plain", *w), ("turned", w[2], w[0], w[1]), ("turned", w[1], w[2], w[0])], None
    return [("joined", "".join(w[:-2]), w[-2], w[-1]), ("plain", w[0], w[1], "".join(w[2:]))], None


@F.pandas_udf(PARSED)
def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for kinds, texts in batches:
        rows = [(parse_person if k == "P" else parse_organisation)(t) for k, t in zip(kinds, texts, strict=True)]
        yield pd.DataFrame({
            "hyps": [[dict(zip(HYPOTHESIS.fieldNames(), h, strict=True)) for h in hyps] for hyps, _ in rows],
            "quoted": [q for _, q in rows],
        })


def sound(c: Column) -> Column:
    """A spelling by sound: doubled letters count once."""
    for a, b in SOUNDS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"(.)\1+", "$1")


def shortened(c: Column) -> Column:
    """Keys that strings of one typo share: the string and all strings that lack one of its letters, or, for long ones, its halves.

    One typo leaves the first or the last ``HALF`` letters of a string of more than twice
    that length as they are; lengths about the limit have both kinds of keys.
    """
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    none = F.array().cast("array<string>")
    letters = F.when((n > 2) & (n <= 2 * HALF + 2), cut).otherwise(none)
    halves = F.when(n > 2 * HALF - 2, F.array(F.concat(F.lit("<"), F.substring(c, 1, HALF)), F.concat(F.lit(">"), F.right(c, F.lit(HALF))))).otherwise(none)
    return F.array_distinct(F.concat(F.array(c), letters, halves))


def full_keys(kind: Column, a: Column, b: Column) -> Column:
    """Keys of the further parts of a full spelling."""
    two = F.concat(F.lit("t"), F.substring(a, 1, 1), F.substring(b, 1, 1))
    person = F.array_union(F.array(F.concat(F.lit("i"), F.substring(a, 1, 1))), _front_keys(a))
    return F.when(kind == "P", person).otherwise(F.array(two, F.lit("b")))


def asked_keys(kind: Column, a: Column, b: Column, initials: Column, alike: Column) -> Column:
    """Keys over which a hypothesis meets full spellings of one main part.

    Persons meet over the first letter of the given name or of a formal name for it and, if
    the surnames sound the same, over the given name without one of its first two letters.
    Organisations meet over the first letters of the two further words (or of an acronym),
    a bare main part meets all of them.
    """
    first = F.transform(F.array_distinct(F.filter(initials, lambda x: x != "")), lambda i: F.concat(F.lit("i"), i))
    person = F.when(alike, F.array_union(first, _front_keys(a))).otherwise(first)
    two = F.concat(F.lit("t"), F.substring(a, 1, 1), F.when(b == "", F.substring(a, 2, 1)).otherwise(F.substring(b, 1, 1)))
    return F.when(kind == "P", person).otherwise(F.array(F.when((a == "") & (b == ""), F.lit("b")).otherwise(two)))


def _front_keys(a: Column) -> Column:
    """The string, and the string without its first and without its second letter."""
    n = F.length(a)
    keys = F.array(a, F.substring(a, F.lit(2), n), F.concat(F.substring(a, 1, 1), F.substring(a, F.lit(3), n)))
    return F.when(n > 2, F.transform(keys, lambda k: F.concat(F.lit("d"), k))).otherwise(F.array().cast("array<string>"))


def near(a: Column, b: Column) -> Column:
    """One typo apart: a letter added, left out, changed or moved to the next place."""
    return (F.levenshtein(a, b) <= 2) & (F.abs(F.length(a) - F.length(b)) <= 1) & (F.least(F.length(a), F.length(b)) >= 3)


def typo(a: Column, b: Column) -> Column:
    """The kind of the typo that makes ``a`` of ``b``; null if they are not one typo apart."""
    letters = [F.array_sort(F.split(x, "")) for x in (a, b)]
    kind = (
        F.when(F.length(a) < F.length(b), "drop").when(F.length(a) > F.length(b), "add")
        .when(letters[0] == letters[1], "swap").otherwise("change")
    )
    return F.when(near(a, b), kind)


def shortens(short: Column, full: Column) -> Column:
    """An abbreviation: the first letter and further letters of the full word in their order."""
    pattern = F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*"))
    return (F.length(short) >= 2) & (F.length(short) < F.length(full)) & F.rlike(full, pattern)


def spellings(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node -> spelling), (spelling, weight), (spelling, hypotheses) of persons and organisations."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.lower(F.trim("type"))]
    rows = nodes.select("node_id", "text", kind.alias("kind"), "occurrences").where(
        F.col("node_id").isNotNull() & F.col("text").isNotNull() & F.col("kind").isNotNull()
    )
    ids = rows.groupBy("node_id").agg(
        F.min(F.struct("text", "kind")).alias("t"),
        F.greatest(F.max("occurrences"), F.lit(1)).alias("weight"),
    ).select("node_id", "t.*", "weight")
    ids = ids.withColumn("p", parsed("kind", "text")).where(F.size("p.hyps") > 0)
    first = F.col("p.hyps")[0]
    ids = ids.withColumn("s", F.concat_ws("|", "kind", first["main"], first["a"], first["b"]))
    ids = staged(ids, "names")
    weights = ids.groupBy("s").agg(F.sum("weight").alias("weight"))
    hyps = ids.select("kind", "s", "p.quoted", F.posexplode("p.hyps").alias("i", "h")).select(
        "kind", "s", "quoted", (F.col("i") == 0).alias("own"), "h.*"
    ).distinct()
    return ids.select("node_id", "s"), weights, hyps


def main_pairs(ask: DataFrame, full: DataFrame) -> DataFrame:
    """(kind, main, other, alike): the main parts of full spellings that are equal, one typo apart or nearly alike by sound.

    Only distinct main parts meet, over the keys of their letters and of their sound; a key
    is shared by few, since it leaves one letter open. ``alike``: they sound the same.
    """
    def keyed(rows: DataFrame, name: str) -> DataFrame:
        d = rows.select("kind", F.col("main").alias(name), F.col("snd").alias(f"snd_{name}")).distinct()
        written = F.transform(shortened(F.col(name)), lambda k: F.xxhash64("kind", F.lit("w"), k))
        heard = F.transform(shortened(F.col(f"snd_{name}")), lambda k: F.xxhash64("kind", F.lit("s"), k))
        return d.select("kind", name, f"snd_{name}", F.explode(F.array_union(written, heard)).alias("k"))

    met = keyed(ask, "main").join(keyed(full, "other"), ["kind", "k"]).drop("k").distinct()
    alike = F.col("snd_main") == F.col("snd_other")
    close = (F.col("main") == F.col("other")) | alike | near(F.col("main"), F.col("other")) | near(F.col("snd_main"), F.col("snd_other"))
    return met.where(close).select("kind", "main", "other", alike.alias("alike"))


def candidates(weights: DataFrame, hyps: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(s, c, weight, own_weight, form, main_op, a_op, b_op): candidate canonical spellings with the operations they need."""
    listed = nicknames.select(F.lower("formal_name").alias("formal"), F.lower("short_name").alias("short"))
    learned = hyps.where("kind = 'P' and quoted is not null and own").select(F.col("a").alias("formal"), F.col("quoted").alias("short"))
    nicks = listed.unionByName(learned).where("formal <> short").distinct()
    nicks = nicks.groupBy("short").agg(F.collect_set("formal").alias("formals"))
    full = hyps.where("own and ((kind = 'P' and length(a) > 1) or (kind = 'O' and a <> '' and b <> ''))")
    full = full.select("kind", F.col("s").alias("c"), "main", "a", "b").distinct()
    common = full.groupBy("kind", "a").agg(F.countDistinct("main").alias("common"))
    full = full.join(common, ["kind", "a"]).join(weights.withColumnRenamed("s", "c"), "c")
    full = full.withColumn("snd", sound(F.col("main")))
    ids = staged(weights.select("s").withColumn("sid", F.monotonically_increasing_id()), "ids")
    full = staged(full.join(ids.withColumnRenamed("s", "c"), "c").withColumnRenamed("sid", "cid"), "full")
    ask = hyps.join(nicks, hyps["a"] == nicks["short"], "left").join(common, ["kind", "a"], "left")
    ask = ask.join(weights.withColumnRenamed("weight", "own_weight"), "s")
    ask = ask.withColumn("common", F.coalesce("common", F.lit(0))).withColumn("snd", sound(F.col("main")))
    initials = F.concat(
        F.array(F.substring("a", 1, 1)),
        F.coalesce(F.transform("formals", lambda f: F.substring(f, 1, 1)), F.array().cast("array<string>")),
    )
    is_full = F.expr("own and ((kind = 'P' and length(a) > 1) or (kind = 'O' and a <> '' and b <> ''))")
    ask = ask.withColumn("is_full", F.max(is_full).over(Window.partitionBy("s")))
    ask = staged(ask.join(ids, "s").withColumns({"initials": initials, "hid": F.monotonically_increasing_id()}), "ask")
    # only ids and hashed keys are shuffled to find who meets whom
    met_mains = staged(main_pairs(ask, full), "mains")
    asks = ask.select("kind", "main", "a", "b", "initials", "hid", "sid").join(met_mains, ["kind", "main"])
    keys = asked_keys(*[F.col(c) for c in ("kind", "a", "b", "initials", "alike")])
    v = asks.select("hid", "sid", "kind", "other", F.explode(keys).alias("g")).select("hid", "sid", F.xxhash64("kind", "other", "g").alias("k"))
    w = full.select("cid", "kind", "main", F.explode(full_keys(F.col("kind"), F.col("a"), F.col("b"))).alias("g"))
    met = v.join(w.select("cid", F.xxhash64("kind", "main", "g").alias("k")), "k").where("sid <> cid").select("hid", "cid").distinct()
    pairs = met.join(ask.alias("v"), "hid").join(full.alias("w"), "cid").where("v.kind = w.kind")
    va, vb, wa, wb = (F.col(x) for x in ("v.a", "v.b", "w.a", "w.b"))
    person = F.col("v.kind") == "P"
    main_op = F.when(F.col("v.main") == F.col("w.main"), "same").when(F.col("v.snd") == F.col("w.snd"), "sound").otherwise(
        F.coalesce(typo(F.col("v.main"), F.col("w.main")), F.when(near(F.col("v.snd"), F.col("w.snd")), "heard"))
    )
    rare = (F.col("v.common") <= 2) | (F.col("v.common") * 10 <= F.col("w.common"))
    rarer = F.col("v.common") * 3 < F.col("w.common")
    given_op = (
        F.when(va == wa, "same")
        .when((F.length(va) == 1) & (va == F.substring(wa, 1, 1)), "initial")
        .when(F.array_contains("v.formals", wa), "nick")
        .when(near(va, wa) & rare & F.col("v.formals").isNull(), typo(va, wa))
        .when((F.length(va) >= 3) & (F.length(va) <= 5) & F.startswith(wa, va) & rarer, "short")
        .when((F.length(va) >= 3) & near(sound(va), sound(wa)) & rare, "heard")
        .when(va == "", "none")
    )
    acronym = (vb == "") & (F.length(va).between(2, 3)) & (va == F.concat(F.substring(wa, 1, 1), F.substring(wb, 1, 1)))
    bare = (va == "") & (vb == "")

    def word_op(x: Column, y: Column) -> Column:
        return F.when(x == y, "same").when(near(x, y), typo(x, y)).when(shortens(x, y), "short").when(
            (F.levenshtein(x, y) <= 3) & (F.length(y) >= 6), "heard"
        )

    a_op = F.when(person, given_op).when(bare, "none").when(acronym, "acronym").otherwise(word_op(va, wa))
    b_op = F.when(person, "same").when(bare, "none").when(acronym, "acronym").otherwise(word_op(vb, wb))
    # a full spelling follows a more frequent one; one with an abbreviated word, a nickname or
    # a given name that is rare against the other follows at any frequency
    higher = F.struct("w.weight", "w.c") > F.struct("v.own_weight", "v.s")
    derived = F.col("a_op").isin("short", "nick", "acronym") | F.col("b_op").isin("short", "acronym")
    derived = derived | (person & F.col("a_op").isin(*TYPOS) & (F.col("v.common") < F.col("w.common")))
    pairs = pairs.withColumn("a_op", a_op).withColumn("b_op", b_op).withColumn("main_op", main_op)
    pairs = pairs.where(~F.col("v.is_full") | higher | derived)
    return pairs.select(
        F.col("v.s").alias("s"), F.col("w.c").alias("c"), F.col("w.weight").alias("weight"), F.col("v.own_weight").alias("own_weight"), F.col("v.form").alias("form"),
        "main_op", "a_op", "b_op",
    ).where("main_op is not null and a_op is not null and b_op is not null").distinct()


def _posterior(prob: dict[str, dict[str, float]]) -> Column:
    total = F.log("weight")
    for part, column in (("form", "form"), ("main", "main_op"), ("a", "a_op"), ("b", "b_op")):
        logs = F.create_map(*[x for k, p in prob[part].items() for x in (F.lit(k), F.lit(math.log(p)))])
        total = total + logs[F.col(column)]
    return total


def attached(found: DataFrame, rounds: int = 2, new_name: float = NEW_NAME) -> DataFrame:
    """(s, c): every spelling with its candidate of maximum posterior; probabilities are re-estimated ``rounds - 1`` times.

    A spelling stays on its own where the hypothesis of a new name is more likely than every
    candidate: its prior is the spelling's own frequency times the chance ``new_name``.
    """
    prob = OPERATIONS
    w = Window.partitionBy("s").orderBy(F.desc("post"), F.desc("weight"), "c")
    for r in range(rounds):
        scored = found.withColumn("post", _posterior(prob)).where(F.col("post") > F.log("own_weight") + new_name)
        best = scored.withColumn("n", F.row_number().over(w)).where("n = 1")
        if r < rounds - 1:
            seen: dict[tuple[str, str], int] = {}
            for row in best.groupBy("form", "main_op", "a_op", "b_op").count().collect():  # at most one row per set of operations
                for part, op in zip(prob, row[:4], strict=True):
                    seen[(part, op)] = seen.get((part, op), 0) + row[4]
            prob = {
                part: {
                    op: (seen.get((part, op), 0) + 50 * p) / (sum(seen.get((part, o), 0) for o in ops) + 50)
                    for op, p in ops.items()
                }
                for part, ops in OPERATIONS.items()
            }
    return best.select("s", "c")


def roots(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(s, root): the end of every chain of attachments, by doubling the steps until nothing changes.

    Of two spellings attached to each other the smaller one becomes the root. Longer circles
    are what remains when a round ends no chain: of these and what leads to them the smallest
    spelling is the root. More than ``most_rounds`` rounds are an error.
    """
    back = links.select(F.col("c").alias("s"), F.col("s").alias("c"), F.lit(True).alias("back"))
    links = links.join(back, ["s", "c"], "left").where(F.col("back").isNull() | (F.col("s") > F.col("c")))
    first = links = staged(links.select("s", F.col("c").alias("root")), "roots")
    before = -1
    for _ in range(most_rounds):
        up = links.select(F.col("s").alias("root"), F.col("root").alias("above"))
        nxt = links.join(up, "root", "left").select("s", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        nxt = staged(nxt, "roots")
        links, open_ = nxt.select("s", "root"), nxt.where("moved").count()
        if open_ == 0:
            return links
        if open_ == before:  # a chain would have come to its end for some of its members
            stuck = first.join(nxt.where("moved").select("s"), "s", "left_semi")
            circles = components(stuck.select(F.col("s").alias("a"), F.col("root").alias("b")))
            return nxt.where("not moved").select("s", "root").unionByName(circles.select(F.col("id").alias("s"), "root"))
        before = open_
    raise RuntimeError("the attachments did not come to an end")


def entities(nodes: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(node_id, entity): the entity of every node that names a person or an organisation.

    ``nodes`` has node_id, text, type and occurrences, ``nicknames`` formal_name and
    short_name; other columns are ignored. Nodes of other types, null ids, and null, blank
    or letterless texts have no entity; a repeated node_id counts once with its greatest
    occurrences (null counts as 1); ties go to the greater frequency, then the smaller
    spelling. Empty tables give no rows; without nicknames only quoted ones are known.
    """
    ids, weights, hyps = spellings(nodes)
    found = staged(candidates(weights, hyps, nicknames), "candidates")
    root = roots(attached(found))
    return ids.join(root, "s", "left").select("node_id", F.coalesce("root", "s").alias("entity"))


def same_pairs(members: DataFrame, block: int = 256) -> DataFrame:
    """(node_id_a, node_id_b): every pair of nodes of one entity, node_id_a < node_id_b.

    The nodes of a large entity are split into blocks of about ``block``; every pair of
    blocks is a key of its own.
    """
    n = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = members.join(n.select("entity", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "entity")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int"))
    rows = rows.select("entity", "node_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("entity", "node_id", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    a = rows.select("entity", "x", "y", F.col("node_id").alias("node_id_a"), F.col("own").alias("oa"))
    b = rows.select("entity", "x", "y", F.col("node_id").alias("node_id_b"), F.col("own").alias("ob"))
    # in a cell of two blocks only pairs across them count, in a cell of one block all
    met = a.join(b, ["entity", "x", "y"]).where("node_id_a < node_id_b and (x = y or oa <> ob)")
    return met.select("node_id_a", "node_id_b")
