"""Relation identification between mentions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.text import first_json_array, segments
from knotwork.runtime import staged

# Relation by the types of an ordered pair.
TYPE_PAIRS = {
    ("PERSON", "ORGANIZATION"): "WORKS_FOR", ("ORGANIZATION", "PERSON"): "EMPLOYS",
    ("PERSON", "LOCATION"): "LOCATED_IN", ("ORGANIZATION", "LOCATION"): "HEADQUARTERED_IN",
    ("PRODUCT", "ORGANIZATION"): "CREATED_BY", ("ORGANIZATION", "PRODUCT"): "CREATOR_OF",
    ("EVENT", "DATE"): "OCCURRED_ON", ("EVENT", "LOCATION"): "OCCURRED_AT",
    ("FACILITY", "LOCATION"): "LOCATED_IN", ("PERSON", "WORK_OF_ART"): "CREATOR_OF",
    ("WORK_OF_ART", "PERSON"): "CREATED_BY",
}
# Phrases that stand between two words, by relation; a phrase takes one entry of every list in turn.
PHRASES = {
    "WORKS_FOR": (
        (("works", "worked", "is employed", "is working"), ("for", "at", "in", "with")),
        (("is a employee of", "is an employee of"),),
        (("joined", "hired by"),),
    ),
    "LOCATED_IN": (
        (("is located", "is situated", "is based", "is found"), ("in",)),
        (("is in", "is at", "in the"),),
    ),
    "PART_OF": (
        (("is part of", "is a division of", "is a subsidiary of", "is a branch of"),),
        (("belongs to", "is owned by"),),
    ),
    "CREATOR_OF": (
        (("created", "developed", "built", "invented", "designed"),),
        (("is the",), ("creator", "author", "developer", "inventor"), ("of",)),
    ),
    "OCCURRED_AT": (
        (("occurred", "happened", "took place", "was held"), ("in", "at", "on")),
        (("was",), ("during", "in", "at")),
    ),
}
WORD = re.compile(r"\w+")
HIT = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("relationship", T.StringType()),
    T.StructField("source_token", T.StringType()), T.StructField("target_token", T.StringType()), T.StructField("matched", T.StringType()),
])
BUCKET = 512


def type_relation(a: Column, b: Column) -> Column:
    pairs = [x for (s, t), r in TYPE_PAIRS.items() for x in (F.lit(f"{s}>{t}"), F.lit(r))]
    return F.create_map(*pairs)[F.concat(a, F.lit(">"), b)]


def proximity(mentions: DataFrame, most: int = 50) -> DataFrame:
    """Relations of mentions at most ``most`` characters apart, by their types.

    ``mentions``: document_id, text, type, start_pos, end_pos. The self-join is over
    buckets of positions, so a long document is spread; confidence is max(0.5, 1 - d/most),
    at most 1 for overlapping mentions. Equal mentions count once.
    """
    m = mentions.select("document_id", "text", "type", "start_pos", "end_pos").distinct()
    m = m.where(F.col("start_pos").isNotNull() & F.col("end_pos").isNotNull())
    order = F.struct("start_pos", "end_pos", "type", "text")
    a = m.select("document_id", F.col("text").alias("source"), F.col("type").alias("source_type"), F.col("end_pos").alias("a_end"), order.alias("a_key"))
    # partners start after a's start and at most ``most`` after its end: the buckets in between
    a = a.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("a_key.start_pos") / BUCKET), F.floor(F.greatest(F.col("a_end") + most, F.col("a_key.start_pos")) / BUCKET)
    )))
    b = m.select("document_id", F.col("text").alias("target"), F.col("type").alias("target_type"), order.alias("b_key"), F.floor(F.col("start_pos") / BUCKET).alias("bucket"))
    near = a.join(b, ["document_id", "bucket"]).where("a_key < b_key").withColumn("distance", F.col("b_key.start_pos") - F.col("a_end"))
    near = near.where(F.col("distance") <= most).withColumn("relationship", type_relation(F.col("source_type"), F.col("target_type")))
    return near.where(F.col("relationship").isNotNull()).select(
        "document_id", "source", "source_type", "target", "target_type", "relationship", "distance",
        F.least(F.lit(1.0), F.greatest(F.lit(0.5), 1 - F.col("distance") / most)).alias("confidence"),
    )


def cooccurrence(docs: DataFrame, entities: DataFrame, threshold: float = 0.5, id_col: str = "document_id") -> DataFrame:
    """Relations of entities that share sentence segments of a document, by Jaccard of their segments.

    ``entities``: document_id, text, type; an entity is in a segment that contains its text.
    Pairs are of distinct (text, type), the smaller first; equal texts make no pair.
    """
    e = entities.select("document_id", "text", "type").where(F.col("text") != "").distinct()
    s = docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(segments(F.col("text"))).alias("segment", "content"))
    hits = e.join(s, "document_id").where(F.contains("content", "text")).select("document_id", "segment", "text", "type")
    freq = hits.groupBy("document_id", "text", "type").agg(F.count(F.lit(1)).alias("frequency"))
    a = hits.select("document_id", "segment", F.struct("text", "type").alias("a"))
    b = hits.select("document_id", "segment", F.struct("text", "type").alias("b"))
    both = a.join(b, ["document_id", "segment"]).where("a < b and a.text <> b.text").groupBy("document_id", "a", "b").agg(F.count(F.lit(1)).alias("common_segments"))
    fa = freq.select("document_id", F.struct("text", "type").alias("a"), F.col("frequency").alias("source_frequency"))
    fb = freq.select("document_id", F.struct("text", "type").alias("b"), F.col("frequency").alias("target_frequency"))
    out = both.join(fa, ["document_id", "a"]).join(fb, ["document_id", "b"])
    strength = F.col("common_segments") / (F.col("source_frequency") + F.col("target_frequency") - F.col("common_segments"))
    return out.withColumn("confidence", strength).where(F.col("confidence") >= threshold).select(
        "document_id", F.col("a.text").alias("source"), F.col("a.type").alias("source_type"),
        F.col("b.text").alias("target"), F.col("b.type").alias("target_type"),
        F.coalesce(type_relation(F.col("a.type"), F.col("b.type")), F.lit("RELATED_TO")).alias("relationship"),
        "confidence", "common_segments", "source_frequency", "target_frequency",
    )


def phrase_table() -> dict[str, list[tuple[int, str, tuple[str, ...]]]]:
    """(group, relation, words) of every phrase, by its first word."""
    out: dict[str, list[tuple[int, str, tuple[str, ...]]]] = {}
    group = 0
    for relation, groups in PHRASES.items():
        for lists in groups:
            for parts in product(*lists):
                words = tuple(" ".join(parts).split())
                out.setdefault(words[0], []).append((group, relation, words))
            group += 1
    return out


def phrase_hits(text: str, table: dict[str, list[tuple[int, str, tuple[str, ...]]]]) -> list[tuple[str, str, str, str]]:
    """(relation, word before, word after, matched text) of every phrase; those of one group do not overlap."""
    spans = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    close = [text[a[1] : b[0]].isspace() for a, b in zip(spans, spans[1:], strict=False)]  # only white space up to the next word
    out, taken = [], {}
    for i in range(1, len(words)):
        for group, relation, phrase in table.get(words[i], ()):
            j = i + len(phrase)
            if j < len(words) and i - 1 >= taken.get(group, 0) and tuple(words[i:j]) == phrase and all(close[i - 1 : j]):
                (a, b), (c, d) = spans[i - 1], spans[j]
                out.append((relation, text[a:b], text[c:d], text[a:d]))
                taken[group] = j + 1
    return out


def rule_hits(docs: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(document_id, relationship, source_token, target_token, matched): word, verb phrase, word; null texts have none."""
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), "text").where(F.col("text").isNotNull())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = phrase_table()
        for pdf in batches:
            out = [(d, *h) for d, t in zip(pdf["document_id"], pdf["text"], strict=True) for h in phrase_hits(t, table)]
            yield pd.DataFrame(out, columns=HIT.fieldNames())

    return rows.mapInPandas(find, HIT)


def rule_relations(docs: DataFrame, entities: DataFrame, id_col: str = "document_id") -> DataFrame:
    """Rule hits whose tokens map to different entities of the document, with confidence 0.7.

    A token maps to the entity of equal text, else to one that contains it or is contained
    in it, ignoring case; the shortest, then the smallest text wins.
    """
    hits = staged(rule_hits(docs, id_col).withColumn("hit", F.monotonically_increasing_id()), "hits")
    e = entities.select("document_id", F.col("text").alias("e_text"), F.col("type").alias("e_type")).distinct()

    def mapped(token: str, name: str) -> DataFrame:
        j = hits.select("hit", "document_id", F.col(token).alias("token")).join(e, "document_id")
        low, t = F.lower("e_text"), F.lower("token")
        j = j.where(F.contains(low, t) | F.contains(t, low))
        best = F.min(F.struct((F.col("e_text") != F.col("token")).alias("x"), F.length("e_text").alias("n"), "e_text", "e_type"))
        return j.groupBy("hit").agg(best.alias(name))

    mapped_hits = hits.join(mapped("source_token", "s"), "hit").join(mapped("target_token", "t"), "hit")
    return mapped_hits.where("s.e_text <> t.e_text").select(
        "document_id", F.col("s.e_text").alias("source"), F.col("s.e_type").alias("source_type"),
        F.col("t.e_text").alias("target"), F.col("t.e_type").alias("target_type"), "relationship",
        F.lit(0.7).alias("confidence"), "matched",
    )


def pair_batches(mentions: DataFrame, batch: int = 10) -> DataFrame:
    """(document_id, source, target, pair_id, batch_id): ordered pairs of the distinct mentions of a document.

    The number of a pair follows from the places of its ends, so the pairs are never sorted.
    """
    m = mentions.select("document_id", "text", "type").distinct()
    w = Window.partitionBy("document_id")
    m = m.withColumn("seq", F.row_number().over(w.orderBy("text", "type")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    a = m.select("document_id", F.col("text").alias("source"), F.col("seq").cast("long").alias("i"), "n")
    b = m.select("document_id", F.col("text").alias("target"), F.col("seq").cast("long").alias("j"))
    pairs = a.join(b, "document_id").where("i < j")
    pairs = pairs.withColumn("pair_id", F.expr("i * (2 * n - i - 1) div 2 + j - i - 1"))
    return pairs.select("document_id", "source", "target", "pair_id", F.floor(F.col("pair_id") / batch).alias("batch_id"))


def model_relations(batches: DataFrame, ask: Callable[[str], str], threshold: float = 0.5) -> DataFrame:
    """Relations from any model, one prompt per batch of pairs; those below ``threshold`` or without confidence are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            replies = []
            for p in pdf["prompt"]:
                try:
                    replies.append(ask(p))
                except Exception:
                    replies.append("")
            yield pd.DataFrame({"document_id": pdf["document_id"], "reply": replies})

    prompt = F.concat(
        F.lit("Name the relationship of each pair. Answer with a JSON array of objects with source, target, relationship and confidence.\n"),
        F.array_join(F.sort_array(F.collect_list(F.format_string("%d. %s - %s", "pair_id", "source", "target"))), "\n"),
    )
    prompts = batches.groupBy("document_id", "batch_id").agg(prompt.alias("prompt")).select("document_id", "prompt")
    replies = prompts.mapInPandas(run, "document_id string, reply string")
    kind = "array<struct<source:string,target:string,relationship:string,confidence:double>>"
    rows = replies.select("document_id", F.explode(F.from_json(first_json_array(F.col("reply")), kind)).alias("r")).select("document_id", "r.*")
    return rows.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def document_classes(nodes: DataFrame) -> DataFrame:
    """(node_id, class, documents): nodes of one set of documents are one class, named by its smallest node_id."""
    sets = nodes.select("node_id", F.array_sort(F.array_distinct(F.filter("documents", lambda x: x.isNotNull()))).alias("documents"))
    sets = sets.where(F.size("documents") > 0).withColumn("h", F.xxhash64("documents"))
    first = sets.groupBy("h").agg(F.min("node_id").alias("class"))
    return sets.join(first, "h").select("node_id", "class", "documents")


def cross_document(nodes: DataFrame, least_common: int = 2, block: int = 512) -> DataFrame:
    """Pairs of classes of nodes that share documents, with the Jaccard of their document sets.

    ``nodes``: node_id, documents. A class (see ``document_classes``) stands for all nodes of
    one document set; its nodes are related to each other with confidence 1. The classes of a
    document are split into blocks of about ``block``, and every pair of blocks is a key of
    its own, so a common document is spread over many tasks.
    """
    kinds = document_classes(nodes).where("node_id = class").where(F.size("documents") >= least_common)
    d = kinds.select("class", F.size("documents").alias("n"), F.explode("documents").alias("document"))
    d = staged(d, "classes")
    size = d.groupBy("document").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    d = d.join(size, "document").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("class", "n", "own", F.struct("document", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).alias("cell"))
    a = d.select(F.col("class").alias("node_a"), F.col("n").alias("na"), F.col("own").alias("oa"), "cell")
    b = d.select(F.col("class").alias("node_b"), F.col("n").alias("nb"), F.col("own").alias("ob"), "cell")
    # in a cell of two blocks only pairs across them count, in a cell of one block all
    met = a.join(b, "cell").where("node_a < node_b and (cell.x = cell.y or oa <> ob)")
    both = met.groupBy("node_a", "node_b", "na", "nb").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least_common)
    return both.select("node_a", "node_b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("confidence"))


def row_classes(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, class): rows that agree in all columns (nulls included) are one class, named by its smallest key."""
    cells = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    named = rows.select(F.col(key).alias("key"), F.xxhash64(cells).alias("h"))
    first = named.groupBy("h").agg(F.min("key").alias("class"))
    return named.join(first, "h").select("key", "class")


def row_similarity(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b, shared_columns, weight): classes of rows that agree in at least one non-null column, a < b.

    Rows that agree in all columns are one class (see ``row_classes``), so a common value
    pairs the distinct rows that hold it, never all rows.
    """
    kinds = rows.groupBy(*columns).agg(F.min(key).alias("class"))
    cells = kinds.select("class", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("c")).where("c.value is not null")
    a, b = cells.select(F.col("class").alias("a"), "c"), cells.select(F.col("class").alias("b"), "c")
    both = a.join(b, "c").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("c.name")).alias("names"))
    return both.select("a", "b", F.array_join("names", "_").alias("shared_columns"), (F.size("names") / len(columns)).alias("weight"))


IDENTIFIERS: dict[str, Callable[..., DataFrame]] = {
    "rule_based": rule_relations, "proximity": proximity, "cooccurrence": cooccurrence, "model": model_relations,
}


def identify(method: str, *args, **options) -> DataFrame:
    if method not in IDENTIFIERS:
        raise ValueError(f"unknown identification method: {method}")
    return IDENTIFIERS[method](*args, **options)
