"""Mention extraction: rule patterns, gazetteers, and pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.text import first_json_array
from knotwork.operators.rules import MATCHERS, find_all
from knotwork.runtime import staged

# Default types in the order of extraction, and those without a rule.
DEFAULT_TYPES = (
    "PERSON", "ORGANIZATION", "LOCATION", "DATE", "TIME", "MONEY", "PERCENT", "FACILITY", "PRODUCT", "EVENT",
    "WORK_OF_ART", "LAW", "LANGUAGE", "CONCEPT",
)
OVERLAP = 200  # characters that neighbouring prompts of a model have in common
MENTION = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()),
])


def rule_mentions(docs: DataFrame, types: tuple[str, ...] = DEFAULT_TYPES, id_col: str = "document_id", chars: int = 0) -> DataFrame:
    """(document_id, text, type, start_pos, end_pos): every match of the rule of every requested type.

    Matches of different types may overlap; null and blank texts have none; types without a
    rule give none. Positions are code points of the text, which is read as a whole, or
    cut to ``chars`` characters where a caller asks for it.
    """
    body = F.substring("text", 1, chars) if chars else F.col("text")
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), body.alias("body")).where(F.trim("body") != "")
    known = tuple(t for t in types if t in MATCHERS)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (d, body[a:b], t, a, b)
                for d, body in zip(pdf["document_id"], pdf["body"], strict=True) for t, a, b in find_all(body, known)
            ]
            yield pd.DataFrame(out, columns=MENTION.fieldNames())

    return rows.mapInPandas(find, MENTION)


ANCHORS = (16, 6, 3, 1)  # a term is found over its first 16, six, three or one characters
FILTER_BITS = 20
AHEAD = 128  # characters that a place takes along to be compared; longer terms are compared with the text itself
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(ANCHORS))]  # a polynomial in the characters
PLACE = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("start_pos", T.IntegerType()),
    T.StructField("anchor", T.StringType()), T.StructField("ahead", T.StringType()),
])


def _gram_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` characters."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    if len(cp) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = sum((cp[k : len(cp) - n + 1 + k] * MIX[k] for k in range(n)), np.uint64(0))
        return h ^ (h >> np.uint64(31))


def _anchor_places(docs: DataFrame, anchors: DataFrame, most_anchors: int) -> DataFrame:
    """(document_id, start_pos, anchor, ahead): the places of the texts at which some term may begin.

    The distinct first characters of the terms go to the workers as hashes, if they are at most
    ``most_anchors``; else every place is one.
    """
    known = None
    if anchors.count() <= most_anchors:
        by_length: dict[int, list[str]] = {}
        for r in anchors.collect():
            by_length.setdefault(len(r["anchor"]), []).append(r["anchor"])
        known = {n: np.unique(np.concatenate([_gram_hashes(x, n) for x in xs])) for n, xs in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        mask, maybe = np.uint64((1 << FILTER_BITS) - 1), {}
        for n, hashes in (known or {}).items():
            maybe[n] = np.zeros(1 << FILTER_BITS, dtype=bool)
            maybe[n][(hashes & mask).astype(np.int64)] = True
        for pdf in batches:
            out = []
            for d, body in zip(pdf["document_id"], pdf["body"], strict=True):
                for n in ANCHORS if known is None else known:
                    if known is None:
                        at = range(max(0, len(body) - n + 1))
                    else:
                        h = _gram_hashes(body, n)
                        at = np.flatnonzero(maybe[n][(h & mask).astype(np.int64)])
                        i = np.minimum(np.searchsorted(known[n], h[at]), len(known[n]) - 1)
                        at = at[known[n][i] == h[at]]
                    out += [(d, int(i), body[i : i + n], body[i : i + AHEAD]) for i in at]
            yield pd.DataFrame(out, columns=PLACE.fieldNames())

    return docs.mapInPandas(places, PLACE)


def gazetteer_mentions(docs: DataFrame, terms: DataFrame, id_col: str = "document_id", most_anchors: int = 1_000_000) -> DataFrame:
    """(document_id, text, type, start_pos, end_pos): every occurrence of every term, as substring.

    ``terms`` (text, type); null and empty ones are left out, repeated ones count once. The
    places of a text at which the first characters of some term stand are joined with the
    terms of these characters, and the whole term is compared. Null and empty texts have none.
    """
    terms = terms.select("text", "type").where((F.col("text") != "") & F.col("type").isNotNull()).distinct()
    n = F.length("text")
    first = F.greatest(*[F.when(n >= a, a).otherwise(ANCHORS[-1]) for a in ANCHORS])
    terms = staged(terms.select("text", "type", F.substring("text", F.lit(1), first).alias("anchor"), n.alias("n")), "terms")
    docs = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col("text").alias("body")).where(F.length("text") > 0)
    met = _anchor_places(docs, terms.select("anchor").distinct(), most_anchors).join(terms, "anchor")
    columns = ["document_id", "text", "type", "start_pos", (F.col("start_pos") + F.col("n")).cast("int").alias("end_pos")]
    found = met.where((F.col("n") <= AHEAD) & F.startswith("ahead", "text")).select(*columns)
    if (terms.agg(F.max("n")).first()[0] or 0) <= AHEAD:
        return found
    long = met.where((F.col("n") > AHEAD) & F.startswith("text", "ahead")).join(docs, "document_id")
    long = long.where(F.substring("body", F.col("start_pos") + 1, F.col("n")) == F.col("text"))
    return found.unionByName(long.select(*columns))


REPLY = "array<struct<text:string,type:string,start_pos:string,end_pos:string>>"


def reply_mentions(replies: DataFrame, id_col: str = "document_id", reply_col: str = "reply") -> DataFrame:
    """Mentions from model replies: the first JSON array, entries with text and type; positions default to 0."""
    parsed = F.from_json(first_json_array(F.col(reply_col)), REPLY)
    rows = replies.select(F.col(id_col).alias("document_id"), F.explode(F.filter(parsed, lambda e: e["text"].isNotNull() & e["type"].isNotNull())).alias("e"))
    return rows.select(
        "document_id", "e.text", "e.type",
        F.coalesce(F.expr("try_cast(e.start_pos as int)"), F.lit(0)).alias("start_pos"),
        F.coalesce(F.expr("try_cast(e.end_pos as int)"), F.lit(0)).alias("end_pos"),
    )


def entity_prompt(text: Column, types: tuple[str, ...] = DEFAULT_TYPES) -> Column:
    return F.concat(
        F.lit("List the entities of these types: " + ", ".join(types) + ". Answer with a JSON array of objects with text, type, start_pos and end_pos.\n\nText:\n"),
        text,
    )


def model_mentions(docs: DataFrame, ask: Callable[[str], str], types: tuple[str, ...] = DEFAULT_TYPES, id_col: str = "document_id", chars: int = 10_000) -> DataFrame:
    """Mentions from any model ``ask(prompt) -> reply``; a failing call gives no mentions.

    A prompt holds at most ``chars`` characters; a longer text is asked in windows that
    overlap by ``OVERLAP`` characters. A mention counts in the window in whose own part
    (without the overlap that follows) it begins.
    """
    step = max(chars - OVERLAP, (chars + 1) // 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for p in pdf["prompt"]:
                try:
                    replies.append(ask(p))
                except Exception:
                    replies.append("")
            yield pd.DataFrame({"w": pdf["w"], "reply": replies})

    last = F.greatest(F.lit(0), F.ceil((F.length("text") - chars) / step)).cast("int")
    windows = docs.where(F.trim("text") != "").select(
        F.col(id_col).cast("string").alias("document_id"), "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("k")
    )
    windows = windows.withColumn("body", F.substring("text", F.col("k") * step + 1, F.lit(chars)))
    keys = F.to_json(F.struct("document_id", "k", "last", "body"))
    prompts = windows.select(keys.alias("w"), entity_prompt(F.col("body"), types).alias("prompt"))
    m = reply_mentions(prompts.mapInPandas(run, "w string, reply string"), "w")
    m = m.withColumn("w", F.from_json("document_id", "document_id string, k int, last int, body string"))
    placed = F.col("end_pos") > F.col("start_pos")
    begins = F.when(placed, F.col("start_pos")).otherwise(F.instr(F.col("w.body"), F.col("text")) - 1)
    shift = F.when(placed, F.col("w.k") * step).otherwise(0)
    return m.where((begins < step) | (F.col("w.k") == F.col("w.last"))).select(
        F.col("w.document_id").alias("document_id"), "text", "type", (F.col("start_pos") + shift).alias("start_pos"), (F.col("end_pos") + shift).alias("end_pos")
    )


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {"rule_based": rule_mentions, "gazetteer": gazetteer_mentions, "model": model_mentions}


def extract(docs: DataFrame, method: str = "rule_based", **options) -> DataFrame:
    if method not in EXTRACTORS:
        raise ValueError(f"unknown extraction method: {method}")
    return EXTRACTORS[method](docs, **options)
