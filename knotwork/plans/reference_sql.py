"""SQL of the registered queries, for comparison."""

from __future__ import annotations

# Fixed values, written out here once more so that an error in the library's own tables shows.
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
AMOUNT = r"\d+(?:,\d+)*(?:\.\d+)?"
FORMS = {
    "DATE": rf"\b(?:{MONTH})\s+\d\d?(?:st|nd|rd|th)?,\s+\d\d\d\d\b|\b\d\d?/\d\d?/\d\d\d?\d?\b",
    "TIME": r"\b\d\d?:\d\d(?:\s*(?:AM|PM|am|pm))?\b",
    "MONEY": rf"[$]{AMOUNT}|{AMOUNT}\s+(?:dollars|baht|USD|THB)\b",
    "PERSON": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "ORGANIZATION": r"\b(?:[A-Z][0-9A-Za-z]*\s+){2,}(?:Inc|LLC|Corp|Company|Co|Ltd)\b",
    "EMAIL": r"\b[\w.%+-]+@[0-9A-Za-z.-]+[.][A-Za-z]{2,}\b",
    "PHONE": r"(?:[+]?\b\d{1,3}[-.\s]?)?(?:[(]?\b|[(])\d{3}[)]?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "URL": r"https?://(?:www[.])?[\w@:%.+~#=-]{1,256}[.][0-9A-Za-z()]{1,6}\b[\w()@:%+.~#?&/=-]*",
}
VERBS = {
    "WORKS_FOR": (r"(?:works|worked|is\s+employed|is\s+working)\s+(?:for|at|in|with)", r"is\s+an?\s+employee\s+of", r"(?:joined|hired\s+by)"),
    "LOCATED_IN": (r"is\s+(?:located|situated|based|found)\s+in", r"(?:is\s+in|is\s+at|in\s+the)"),
    "PART_OF": (r"is\s+(?:part|a\s+division|a\s+subsidiary|a\s+branch)\s+of", r"(?:belongs\s+to|is\s+owned\s+by)"),
    "CREATOR_OF": (r"(?:created|developed|built|invented|designed)", r"is\s+the\s+(?:creator|author|developer|inventor)\s+of"),
    "OCCURRED_AT": (r"(?:occurred|happened|took\s+place|was\s+held)\s+(?:in|at|on)", r"was\s+(?:during|in|at)"),
}
SPOKEN = "('WORKS_FOR', 'works for'), ('LOCATED_IN', 'is located in'), ('PART_OF', 'is part of'), ('CREATOR_OF', 'developed'), ('OCCURRED_AT', 'took place in')"
PAIRS = """('PERSON', 'ORGANIZATION', 'WORKS_FOR'), ('ORGANIZATION', 'PERSON', 'EMPLOYS'), ('PERSON', 'LOCATION', 'LOCATED_IN'),
('ORGANIZATION', 'LOCATION', 'HEADQUARTERED_IN'), ('PRODUCT', 'ORGANIZATION', 'CREATED_BY'), ('ORGANIZATION', 'PRODUCT', 'CREATOR_OF'),
('EVENT', 'DATE', 'OCCURRED_ON'), ('EVENT', 'LOCATION', 'OCCURRED_AT'), ('FACILITY', 'LOCATION', 'LOCATED_IN'),
('PERSON', 'WORK_OF_ART', 'CREATOR_OF'), ('WORK_OF_ART', 'PERSON', 'CREATED_BY')"""
INV = """('WORKS_FOR', 'EMPLOYS'), ('EMPLOYS', 'WORKS_FOR'), ('LOCATED_IN', 'CONTAINS'), ('CONTAINS', 'LOCATED_IN'), ('PART_OF', 'HAS_PART'),
('HAS_PART', 'PART_OF'), ('CREATOR_OF', 'CREATED_BY'), ('CREATED_BY', 'CREATOR_OF'), ('OWNER_OF', 'OWNED_BY'), ('OWNED_BY', 'OWNER_OF'),
('PARENT_OF', 'CHILD_OF'), ('CHILD_OF', 'PARENT_OF')"""

NL = """nl AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) = 1),
n AS (SELECT * FROM nl WHERE deleted_at IS NULL)"""
EL = """el AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) = 1),
e AS (SELECT edge_id, lower(trim(source_id)) AS source_id, lower(trim(target_id)) AS target_id, type, confidence, occurrences, documents, bidirectional
  FROM el WHERE trim(source_id) <> '' AND trim(target_id) <> '')"""
CL = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
INC = """inc AS (SELECT source_id AS node_id, 'outgoing' AS direction, edge_id, target_id AS neighbour_id, type, confidence FROM e
  UNION ALL SELECT target_id, 'incoming', edge_id, source_id, type, confidence FROM e WHERE source_id <> target_id)"""
NAMED = """named AS (SELECT e.*, s.text AS source_text, s.type AS source_type, t.text AS target_text, t.type AS target_type
  FROM e JOIN n s ON s.node_id = e.source_id JOIN n t ON t.node_id = e.target_id)"""
CTX = "ctx AS (SELECT text, type, c.document AS document_id, c.start_pos AS start_pos, c.end_pos AS end_pos FROM (SELECT text, type, unnest(contexts) AS c FROM n) WHERE c IS NOT NULL)"


def plain(text: str) -> str:
    """The text with non-ASCII letters and digits as ``_``, white space as a blank, full-width and Thai digits as ``0`` and all else outside of ASCII as ``,``; of equal length."""
    spaces = rf"regexp_replace({text}, '[\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"
    digits = rf"regexp_replace({spaces}, '[\x{{FF10}}-\x{{FF19}}\x{{0E50}}-\x{{0E59}}]', '0', 'g')"
    return rf"regexp_replace(regexp_replace({digits}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ',', 'g'), '[^\x00-\x7F]', '_', 'g')"


def divisible(c: str) -> str:
    return f"('0x' || left({c}, 8))::BIGINT % 20 = 0"


DOCS = f"d AS (SELECT document_id, doc_id, text, {plain('text')} AS plain FROM documents)"
SPLIT = " UNION ALL ".join(
    f"SELECT document_id, text, '{t}' AS type, regexp_extract_all(plain, '{p}') AS h, string_split_regex(plain, '{p}') AS g FROM d" for t, p in FORMS.items()
)
# the matches of every rule with their places: what lies between them is what the rule splits off
MENTIONS = f"""{DOCS}, g AS ({SPLIT}), u AS (SELECT *, unnest(range(1, len(h) + 1)) AS k FROM g),
    w AS (SELECT document_id, text AS body, type, length(h[k]) AS n,
      (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start_pos FROM u),
    m AS (SELECT document_id, type, substr(body, start_pos + 1, n) AS text, start_pos, start_pos + n AS end_pos FROM w)"""
WORD, BLANK = r"([\p{L}\p{N}_]+)", r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def hits(of: str, key: str) -> str:
    """SQL of (key, relationship, source_token, target_token): every verb phrase between two words of a text."""
    forms = [(kind, WORD + BLANK + p.replace(r"\s+", BLANK) + BLANK + WORD) for kind, phrases in VERBS.items() for p in phrases]
    return " UNION ALL ".join(
        f"SELECT {key}, '{kind}' AS relationship, unnest(regexp_extract_all(text, '{p}', 1, 'i')) AS source_token, unnest(regexp_extract_all(text, '{p}', 2, 'i')) AS target_token FROM {of}"
        for kind, p in forms
    )


SAID = f"""sp(kind, said) AS (VALUES {SPOKEN}), said AS (SELECT named.*, source_text || ' ' || said || ' ' || target_text || '.' AS sentence FROM named JOIN sp ON sp.kind = named.type)"""
BEST = """SELECT hid, min(row(en.t <> {0}, length(en.t), en.t, en.y)) AS b FROM hh JOIN en USING (document_id)
        WHERE contains(lower(en.t), lower({0})) OR contains(lower({0}), lower(en.t)) GROUP BY hid"""
RELATED = f"""hh AS (SELECT *, row_number() OVER () AS hid FROM ({hits('dd', 'document_id')})),
        en AS (SELECT edge_id AS document_id, source_text AS t, source_type AS y FROM said UNION SELECT edge_id, target_text, target_type FROM said),
        ms AS ({BEST.format('source_token')}), mt AS ({BEST.format('target_token')}),
        rr AS (SELECT document_id, ms.b[3] AS source, ms.b[4] AS source_type, mt.b[3] AS target, mt.b[4] AS target_type, relationship FROM hh JOIN ms USING (hid) JOIN mt USING (hid) WHERE ms.b[3] <> mt.b[3])"""
TERMS = "k AS (SELECT DISTINCT text AS term, type FROM n WHERE text <> '' AND type IS NOT NULL)"
GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i::BIGINT, 3)))"
CHARS = "list_distinct(string_split({0}, ''))"
NEAR = f"""t AS (SELECT DISTINCT lower(text) AS t, type FROM n WHERE text <> ''),
        p AS (SELECT a.t AS short, b.t AS long, a.type FROM t a JOIN t b ON a.type = b.type AND length(a.t) < length(b.t) AND contains(b.t, a.t)),
        s AS (SELECT *, CASE WHEN length(short) < 3 THEN len({CHARS.format('short')}) / len({CHARS.format('long')}) ELSE len({GRAMS.format('short')}) / len({GRAMS.format('long')}) END AS s FROM p)"""
DOCSETS = """sets AS (SELECT node_id, list_sort(list_distinct(list_filter(documents, lambda x: x IS NOT NULL))) AS s FROM n),
cls AS (SELECT node_id, s, min(node_id) OVER (PARTITION BY s) AS c FROM sets WHERE len(s) > 0)"""
SUPPLIERS = """s AS (SELECT s_suppkey AS k, s_nationkey AS n, floor(s_acctbal / 1000) AS b, min(s_suppkey) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) AS c FROM supplier)"""
HOPS = """adj AS (SELECT DISTINCT node_id AS a, neighbour_id AS b FROM inc WHERE coalesce(confidence, 0) >= 0.5),
r(start, v, hop) AS (SELECT DISTINCT node_id, node_id, 0 FROM starts
  UNION SELECT r.start, adj.b, r.hop + 1 FROM r JOIN adj ON adj.a = r.v WHERE r.hop < {0}),
near AS (SELECT start, v AS node_id, min(hop) AS hop FROM r GROUP BY ALL)"""
EGO = f"""{NL}, {EL}, {INC}, starts AS (SELECT node_id FROM n WHERE {divisible('node_id')}), {HOPS.format(2)},
ego AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY start ORDER BY hop, node_id) <= 50)"""
VEC = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
s AS (SELECT a.id AS query_id, b.id, b.label, list_cosine_similarity(a.x, b.x) AS c FROM v a, v b WHERE a.id % 20 = 0)"""


def bm25(queries: str) -> str:
    return rf"""q AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM ({queries})),
    dt AS (SELECT document_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
    tf AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    size AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean FROM dt),
    score AS (SELECT query_id, id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), size GROUP BY ALL)"""


VHITS = """vv AS (SELECT document_id, chunk_index, min(embedding::DOUBLE[]) AS x FROM chunk_vectors
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY ALL),
  vq AS (SELECT doc_id AS query_id, x FROM vv JOIN documents USING (document_id) WHERE doc_id % 20 = 0),
  best AS (SELECT query_id, document_id AS id, max(list_cosine_similarity(vv.x, vq.x)) AS c FROM vv, vq GROUP BY ALL),
  hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 12) DESC, id) AS rank FROM best QUALIFY rank <= 10)"""


def found_in(mark: str, before: int, after: int) -> str:
    """SQL of the end just past the first mark near e, or null."""
    width = before + after
    at = f"instr(substr(text, (e - {before} + 1)::BIGINT, {width}), {mark})"
    return f"CASE WHEN {at} > 0 AND e - {before} + {at} > 1 THEN e - {before} + {at} - 1 + length({mark}) END"


UUID5 = """h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32]"""
STOP = f"CASE WHEN e >= n THEN e ELSE coalesce({found_in('chr(10) || chr(10)', 200, 200)}, {found_in(chr(39) + '. ' + chr(39), 200, 50)}, {found_in(chr(39) + ' ' + chr(39), 20, 20)}, e) END"

CHUNKED = f"""w AS (
          SELECT document_id, text, n, start, k, {STOP} AS stop FROM (SELECT document_id, text, length(text) AS n, 0::BIGINT AS start, 0::BIGINT AS k, least(1000, length(text)) AS e FROM documents WHERE text <> '')
          UNION ALL SELECT document_id, text, n, start, k, {STOP} AS stop FROM (SELECT document_id, text, n, s AS start, k, least(s + 1000, n) AS e
            FROM (SELECT document_id, text, n, greatest(stop - 200, start + 1) AS s, k + 1 AS k FROM w WHERE stop < n))),
        c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS chunk_index FROM w
          WHERE n <= 1000 OR length(regexp_replace(substr(text, start + 1, stop - start), '\\s', '', 'g')) > 0)"""

ORACLE = {
    "extract_rule_mentions": f"WITH {MENTIONS} SELECT document_id, type, text, count(*) AS n FROM m GROUP BY ALL",
    "mention_spans": f"WITH {MENTIONS} SELECT document_id, type, text, start_pos, end_pos FROM m",
    "truncate_inputs": "SELECT doc_id, md5(left(text, 8000)) AS cut, length(left(text, 8000)) AS n FROM documents",
    "sentence_segments": r"""WITH s AS (SELECT doc_id, string_split_regex(text, '[.!?]\s+') AS p FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, unnest(range(0, len(p))) AS segment, md5(unnest(p)) AS content_md5 FROM s""",
    "chunk_documents": f"""WITH RECURSIVE {CHUNKED},
        i AS (SELECT *, sha1(unhex(repeat('0', 32)) || encode(document_id || '_' || chunk_index)) AS h FROM c)
        SELECT {UUID5} AS chunk_id, document_id, chunk_index, start, stop::BIGINT AS stop FROM i""",
    "metadata_merge": """WITH m AS (SELECT edge_id, j.key AS field, j.value AS v FROM edges, json_each(edges.metadata) j
          WHERE source_id IS NOT NULL AND json_valid(metadata) AND json_type(metadata) = 'OBJECT'),
        x AS (SELECT edge_id, field, v ->> '$' AS v FROM m WHERE json_type(v) <> 'ARRAY'
          UNION ALL SELECT edge_id, field, a.value ->> '$' FROM m, json_each(m.v) a WHERE json_type(m.v) = 'ARRAY')
        SELECT edge_id, field, array_to_string(list_sort(list_distinct(list(v))), ',') AS values FROM x WHERE v IS NOT NULL GROUP BY ALL""",
    "fixed_chunks": """WITH s AS (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 500 + 1)) AS chunk_index FROM documents WHERE text <> '')
        SELECT doc_id, chunk_index, md5(substr(text, chunk_index * 500 + 1, 600)) AS content_md5 FROM s""",
    "chunk_ids": f"""WITH {CL}, h AS (SELECT chunk_id, sha1(unhex(repeat('0', 32)) || encode(document_id || '_' || chunk_index)) AS h FROM c)
        SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', h[17:17]), 1) || h[18:20] || '-' || h[21:32] AS derived_id FROM h""",
    "node_ids": f"WITH {NL} SELECT node_id, md5(text || '_' || type) AS derived_id FROM n",
    "trigram_jaccard": f"""WITH s AS (SELECT s_suppkey AS k, lower(s_name) AS t FROM supplier), p AS (SELECT a.k, {GRAMS.format('a.t')} AS x, {GRAMS.format('b.t')} AS y FROM s a JOIN s b ON b.k = a.k + 1)
        SELECT k, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS similarity FROM p""",
    "resolve_exact": f"""WITH {NL} SELECT lower(text) AS folded, type, arg_min(node_id, (-coalesce(occurrences, 0), node_id)) AS canonical, count(*) AS n_nodes,
        sum(coalesce(occurrences, 0))::BIGINT AS occurrences FROM n GROUP BY ALL""",
    "resolve_near_dup": f"""WITH {NL}, {NEAR}
        SELECT short, long, type, round(s, 6) AS similarity FROM s WHERE s >= 0.85""",
    "resolve_canonical": f"""WITH {NL}, {NEAR}
        SELECT long AS text, type, short AS canonical FROM s WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY long, type ORDER BY s DESC, short) = 1""",
    "embedding_duplicates": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.label = b.label AND a.id < b.id)
        SELECT a, b, round(c, 6) AS similarity FROM p WHERE c >= 0.4""",
    "node_upsert": f"""WITH {MENTIONS},
        a AS (SELECT lower(text) AS folded, type, arg_min(text, (document_id, start_pos, text)) AS text, count(*) AS occurrences,
          array_to_string(list_sort(list_distinct(list(document_id))), ',') AS documents FROM m GROUP BY ALL)
        SELECT md5(text || '_' || type) AS node_id, text, type, occurrences, documents, occurrences AS n_contexts FROM a""",
    "mention_node_links": f"""WITH {MENTIONS}, a AS (SELECT lower(text) AS f, type, arg_min(text, (document_id, start_pos, text)) AS first FROM m GROUP BY ALL)
        SELECT md5(first || '_' || m.type) AS node_id, document_id, count(*) AS n, min(start_pos) AS first_pos FROM m JOIN a ON a.f = lower(m.text) AND a.type = m.type GROUP BY ALL""",
    "node_remove": f"WITH {NL} SELECT node_id, text, type FROM n WHERE NOT ({divisible('node_id')})",
    "node_remove_edges": f"""WITH {NL}, {EL}, gone AS (SELECT node_id FROM n WHERE {divisible('node_id')})
        SELECT edge_id, source_id, target_id FROM e WHERE source_id NOT IN (SELECT node_id FROM gone) AND target_id NOT IN (SELECT node_id FROM gone)""",
    "edge_remove": f"WITH {EL} SELECT edge_id, type FROM e WHERE NOT ({divisible('edge_id')})",
    "confidence_cut": f"WITH {EL} SELECT count(*) FILTER (coalesce(confidence, 0) >= 0.8) AS kept, count(*) FILTER (coalesce(confidence, 0) < 0.8) AS removed FROM e",
    "nodes_by_type": f"WITH {NL} SELECT type, count(*) AS n_nodes, sum(occurrences)::BIGINT AS occurrences FROM n GROUP BY ALL",
    "nodes_by_document": f"WITH {NL}, x AS (SELECT DISTINCT unnest(documents) AS document, node_id FROM n) SELECT * FROM x WHERE document IS NOT NULL",
    "node_lookup": f"""WITH {NL}, b AS (SELECT lower(text) AS f, arg_min(node_id, (-coalesce(occurrences, 0), node_id)) AS node_id FROM n GROUP BY ALL)
        SELECT DISTINCT text, b.node_id FROM n JOIN b ON b.f = lower(n.text)""",
    "node_merge": f"""WITH {NL}, b AS (SELECT lower(text) AS f, type, arg_min(node_id, (-coalesce(occurrences, 0), node_id)) AS p FROM n GROUP BY ALL),
        m AS (SELECT n.*, b.p FROM n JOIN b ON b.f = lower(n.text) AND b.type = n.type),
        g AS (SELECT p, sum(coalesce(occurrences, 0))::BIGINT AS occurrences, len(list_filter(list_distinct(flatten(list(coalesce(documents, [])))), lambda x: x IS NOT NULL)) AS n_documents FROM m GROUP BY ALL)
        SELECT p AS node_id, n.text, g.occurrences, n_documents::BIGINT AS n_documents FROM g JOIN n ON n.node_id = g.p""",
    "node_merge_edges": f"""WITH {NL}, {EL}, b AS (SELECT lower(text) AS f, type, arg_min(node_id, (-coalesce(occurrences, 0), node_id)) AS p FROM n GROUP BY ALL),
        a AS (SELECT node_id, b.p FROM n JOIN b ON b.f = lower(n.text) AND b.type = n.type),
        x AS (SELECT coalesce(s.p, source_id) AS s, coalesce(t.p, target_id) AS t, e.type, confidence, occurrences FROM e LEFT JOIN a s ON s.node_id = source_id LEFT JOIN a t ON t.node_id = target_id)
        SELECT md5(s || '_' || t || '_' || type) AS edge_id, max(confidence) AS confidence, sum(coalesce(occurrences, 1))::BIGINT AS occurrences FROM x WHERE s <> t GROUP BY s, t, type""",
    "gazetteer_mentions": f"WITH {NL}, {TERMS} SELECT document_id, term AS text, type, instr(documents.text, term) - 1 AS first_pos FROM documents JOIN k ON contains(documents.text, term)",
    "cooccurrence_relations": rf"""WITH {NL}, {TERMS}, tp(a, b, r) AS (VALUES {PAIRS}),
        dk AS (SELECT document_id, term, type FROM documents JOIN k ON contains(documents.text, term)),
        sg AS (SELECT document_id, unnest(range(0, len(p))) AS segment, unnest(p) AS content FROM (SELECT document_id, string_split_regex(text, '[.!?]\s+') AS p FROM documents WHERE text IS NOT NULL)),
        h AS (SELECT DISTINCT document_id, segment, term, type FROM sg JOIN dk USING (document_id) WHERE contains(content, term)),
        f AS (SELECT document_id, term, type, count(*) AS f FROM h GROUP BY ALL),
        b AS (SELECT a.document_id, a.term AS source, a.type AS source_type, b.term AS target, b.type AS target_type, count(*) AS common_segments FROM h a JOIN h b ON a.document_id = b.document_id AND a.segment = b.segment AND a.term < b.term GROUP BY ALL),
        s AS (SELECT b.*, common_segments / (x.f + y.f - common_segments) AS c FROM b JOIN f x ON x.document_id = b.document_id AND x.term = source AND x.type = source_type
          JOIN f y ON y.document_id = b.document_id AND y.term = target AND y.type = target_type)
        SELECT document_id, source, source_type, target, target_type, coalesce(r, 'RELATED_TO') AS relationship, round(c, 6) AS confidence, common_segments
        FROM s LEFT JOIN tp ON tp.a = source_type AND tp.b = target_type WHERE c >= 0.5""",
    "proximity_relations": f"""WITH {NL}, {CTX}, m AS (SELECT DISTINCT * FROM ctx WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL), tp(a, b, r) AS (VALUES {PAIRS})
        SELECT a.document_id, a.text AS source, b.text AS target, r AS relationship, (b.start_pos - a.end_pos)::BIGINT AS distance,
          round(least(1.0, greatest(0.5, 1 - (b.start_pos - a.end_pos) / 50)), 6) AS confidence
        FROM m a JOIN m b ON a.document_id = b.document_id AND (a.start_pos, a.end_pos, a.type, a.text) < (b.start_pos, b.end_pos, b.type, b.text)
          AND b.start_pos - a.end_pos <= 50 JOIN tp ON tp.a = a.type AND tp.b = b.type""",
    "rule_relation_hits": f"""WITH {NL}, {EL}, {NAMED}, {SAID}, dd AS (SELECT 0 AS k, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 0, sentence FROM said),
        h AS ({hits('dd', 'k')}) SELECT relationship, source_token, target_token, count(*) AS n FROM h GROUP BY ALL""",
    "pair_batches": f"""WITH {NL}, {TERMS}, m AS (SELECT document_id, count(*) AS k FROM documents JOIN k ON contains(documents.text, term) GROUP BY ALL),
        p AS (SELECT document_id, unnest(range(0, k * (k - 1) // 2)) AS i FROM m)
        SELECT document_id, i // 10 AS batch_id, count(*) AS n_pairs FROM p GROUP BY ALL""",
    "cross_document_relations": f"""WITH {NL}, {DOCSETS}, d AS (SELECT c AS node_id, len(s) AS k, unnest(s) AS d FROM (SELECT DISTINCT c, s FROM cls) WHERE len(s) >= 2),
        b AS (SELECT a.node_id AS node_a, b.node_id AS node_b, a.k AS ka, b.k AS kb, count(*) AS common FROM d a JOIN d b ON a.d = b.d AND a.node_id < b.node_id GROUP BY ALL HAVING count(*) >= 2)
        SELECT node_a, node_b, common, round(common / (ka + kb - common), 6) AS confidence FROM b""",
    "cross_document_classes": f"WITH {NL}, {DOCSETS} SELECT node_id, c AS class FROM cls",
    "tabular_row_similarity": f"""WITH {SUPPLIERS}, k AS (SELECT DISTINCT c, n, b FROM s)
        SELECT x.c AS a, y.c AS b, CASE WHEN x.n = y.n THEN 's_nationkey' ELSE 'balance' END AS shared_columns, 0.5::DOUBLE AS weight FROM k x JOIN k y ON x.c < y.c AND (x.n = y.n OR x.b = y.b)""",
    "tabular_row_classes": f"WITH {SUPPLIERS} SELECT k AS key, c AS class FROM s",
    "rows_to_text": "SELECT c_custkey, 'c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_mktsegment: ' || c_mktsegment AS line FROM customer",
    "json_reply_parse": f"""WITH {NL}, x AS (SELECT *, ('0x' || left(node_id, 2))::INT % 5 AS k FROM n WHERE text IS NOT NULL)
        SELECT node_id, text, type, 0::BIGINT AS start_pos, CASE WHEN k = 3 THEN 0 ELSE length(text) END::BIGINT AS end_pos, CASE WHEN k = 1 THEN 2 ELSE 1 END::BIGINT AS n FROM x WHERE k IN (0, 1, 3)""",
    "rule_relations": f"""WITH {NL}, {EL}, {NAMED}, {SAID}, dd AS (SELECT edge_id AS document_id, sentence AS text FROM said), {RELATED}
        SELECT document_id, source, source_type, target, target_type, relationship FROM rr""",
    "edge_build": f"""WITH {NL}, {EL}, {NAMED}, i AS (SELECT lower(text) AS f, type, min(node_id) AS id FROM n GROUP BY ALL)
        SELECT md5(s.id || '_' || t.id || '_' || named.type) AS edge_id, s.id AS source_id, t.id AS target_id, named.type, coalesce(confidence, 1.0) AS confidence
        FROM named JOIN i s ON s.f = lower(source_text) AND s.type = source_type JOIN i t ON t.f = lower(target_text) AND t.type = target_type
        WHERE coalesce(confidence, 1.0) >= 0.5 AND s.id <> t.id""",
    "edge_inverse": f"""WITH {EL}, inv(a, b) AS (VALUES {INV}) SELECT edge_id, source_id, target_id, type FROM e
        UNION ALL SELECT md5(target_id || '_' || source_id || '_' || b), target_id, source_id, b FROM e JOIN inv ON inv.a = e.type WHERE bidirectional""",
    "edge_upsert": """SELECT edge_id, source_id, target_id, round(max(confidence), 6) AS confidence, sum(coalesce(occurrences, 1))::BIGINT AS occurrences,
        array_to_string(list_sort(list_filter(list_distinct(flatten(list(coalesce(documents, [])))), lambda x: x IS NOT NULL)), ',') AS documents
        FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY edge_id, source_id, target_id, type""",
    "edges_by_node": f"WITH {EL}, {INC} SELECT node_id, direction, edge_id, neighbour_id FROM inc",
    "edges_between": f"""WITH {EL}, p AS (SELECT source_id AS a, target_id AS b FROM e WHERE {divisible('edge_id')}), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p)
        SELECT edge_id, type FROM e WHERE EXISTS (SELECT 1 FROM q WHERE a = source_id AND b = target_id)""",
    "edges_filter_confidence": f"WITH {EL} SELECT edge_id, confidence FROM e WHERE confidence >= 0.8",
    "merge_parallel_edges": """SELECT arg_min(edge_id, (-coalesce(confidence, 0), edge_id)) AS edge_id, source_id, target_id, type, max(coalesce(confidence, 0)) AS confidence,
        sum(coalesce(occurrences, 1))::BIGINT AS occurrences, count(*) AS merged FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY source_id, target_id, type""",
    "query_entities": f"""WITH {NL} SELECT node_id, text, type FROM n WHERE contains(lower(text), 'berg')
        UNION ALL SELECT node_id, text, type FROM n WHERE type = 'PRODUCT' AND contains(lower(text), 'an')""",
    "query_relationships": f"WITH {NL}, {EL}, {NAMED} SELECT edge_id, source_text, target_text, type, confidence FROM named WHERE confidence >= 0.7 AND contains(lower(source_text), 'an')",
    "entity_relationships": f"""WITH {NL}, {EL}, {INC} SELECT inc.node_id, direction, edge_id, o.text AS neighbour_text FROM inc JOIN n ON n.node_id = inc.node_id
        JOIN n o ON o.node_id = neighbour_id WHERE confidence >= 0.5""",
    "shortest_path": f"""WITH RECURSIVE {NL}, {EL}, {INC}, pr AS (SELECT node_id AS source, lead(node_id) OVER (PARTITION BY left(node_id, 2) ORDER BY node_id) AS target FROM n WHERE {divisible('node_id')}),
        starts AS (SELECT source AS node_id FROM pr WHERE target IS NOT NULL), {HOPS.format(3)}
        SELECT source, target, hop::BIGINT AS hops, hop::BIGINT AS n_edges FROM near JOIN pr ON pr.source = near.start AND pr.target = near.node_id""",
    "paths_all_simple": """WITH RECURSIVE se AS (
          SELECT md5(c_name || '_CUSTOMER') AS s, md5(n_name || '_NATION') AS t FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION SELECT md5(s_name || '_SUPPLIER'), md5(n_name || '_NATION') FROM supplier JOIN nation ON s_nationkey = n_nationkey
          UNION SELECT md5(n_name || '_NATION'), md5(r_name || '_REGION') FROM nation JOIN region ON n_regionkey = r_regionkey
          UNION SELECT md5(p_name || ' #' || p_partkey || '_PRODUCT'), md5(s_name || '_SUPPLIER') FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
        adj AS (SELECT s AS a, t AS b FROM se UNION SELECT t, s FROM se),
        w AS (SELECT md5(r_name || '_REGION') AS source, [md5(r_name || '_REGION')] AS nodes FROM region
          UNION ALL SELECT source, list_append(nodes, b) FROM w JOIN adj ON adj.a = nodes[-1] WHERE len(nodes) <= 3 AND NOT list_contains(nodes, b))
        SELECT source, nodes[-1] AS target, array_to_string(nodes, '>') AS nodes FROM w WHERE len(nodes) > 1 AND nodes[-1] IN (SELECT md5(s_name || '_SUPPLIER') FROM supplier)""",
    "ego_network_nodes": f"WITH RECURSIVE {EGO} SELECT start, ego.node_id, hop::BIGINT AS hop, n.text FROM ego LEFT JOIN n ON n.node_id = ego.node_id",
    "ego_network_edges": f"""WITH RECURSIVE {EGO} SELECT s.start, edge_id FROM e JOIN ego s ON s.node_id = source_id JOIN ego t ON t.node_id = target_id AND t.start = s.start
        WHERE coalesce(confidence, 0) >= 0.5""",
    "graph_statistics": f"""WITH {NL}, {EL}, {INC} SELECT 'nodes' AS metric, count(*)::DOUBLE AS value FROM n UNION ALL SELECT 'edges', count(*) FROM e
        UNION ALL SELECT 'nodes:' || type, count(*) FROM n GROUP BY type UNION ALL SELECT 'edges:' || type, count(*) FROM e GROUP BY type
        UNION ALL SELECT 'documents', count(DISTINCT d) FROM (SELECT unnest(documents) AS d FROM n)
        UNION ALL SELECT 'average_degree', round((SELECT count(*) FROM inc WHERE node_id IN (SELECT node_id FROM n)) / (SELECT count(*) FROM n), 6)""",
    "star_statistics": """SELECT 'CUSTOMER' AS type, count(DISTINCT c_name) AS n FROM customer UNION ALL SELECT 'SUPPLIER', count(DISTINCT s_name) FROM supplier
        UNION ALL SELECT 'NATION', count(*) FROM nation UNION ALL SELECT 'REGION', count(*) FROM region UNION ALL SELECT 'PRODUCT', count(*) FROM part
        UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        UNION ALL SELECT 'PART_OF', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 'CREATED_BY', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)""",
    "store_statistics": f"""WITH {NL}, {EL}, {CL} SELECT 'chunks' AS metric, count(*) AS value FROM c UNION ALL SELECT 'entities', count(*) FROM n UNION ALL SELECT 'relationships', count(*) FROM e
        UNION ALL SELECT 'documents', count(DISTINCT document_id) FROM c UNION ALL SELECT 'chunks:' || coalesce(document_type, 'unknown'), count(*) FROM c GROUP BY document_type
        UNION ALL SELECT 'entities:' || type, count(*) FROM n GROUP BY type""",
    "document_counters": f"""WITH {NL}, {EL}, {CTX}, m AS (SELECT document_id, count(*) AS mentions, count(DISTINCT (lower(text), type)) AS nodes FROM ctx GROUP BY ALL),
        d AS (SELECT document_id, count(DISTINCT edge_id) AS edges FROM (SELECT unnest(documents) AS document_id, edge_id FROM e) GROUP BY ALL)
        SELECT document_id, coalesce(mentions, 0) AS mentions, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM m FULL JOIN d USING (document_id)""",
    "get_document": f"""WITH {CL} SELECT document_id, count(*) AS n_chunks, md5(string_agg(content, chr(10) ORDER BY chunk_index, content)) AS text_md5 FROM c WHERE content IS NOT NULL GROUP BY ALL""",
    "document_entities": f"WITH {NL}, {CTX} SELECT document_id, text, type, min(start_pos)::BIGINT AS first_pos FROM ctx GROUP BY ALL",
    "entity_documents": f"""WITH {NL}, x AS (SELECT DISTINCT unnest(documents) AS document_id, node_id FROM n)
        SELECT node_id, count(*) AS n_documents, count(DISTINCT lang) AS n_langs FROM x JOIN documents USING (document_id) GROUP BY ALL""",
    "entity_chunk_links": f"""WITH RECURSIVE {NL}, {CHUNKED}, x AS (SELECT node_id, unnest(contexts) AS c FROM n),
        l AS (SELECT DISTINCT node_id, c.document AS document_id, (c.start_pos + 200) // 1000 AS chunk_index FROM x WHERE c.start_pos >= 0)
        SELECT node_id, document_id, chunk_index::BIGINT AS chunk_index FROM l WHERE (document_id, chunk_index) IN (SELECT document_id, chunk_index FROM c)""",
    "knn_cosine": f"WITH {VEC} SELECT query_id, id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s QUALIFY rank <= 5",
    "knn_filtered_offset": f"""WITH {VEC}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s WHERE label < 5)
        SELECT query_id, id, rank - 2 AS rank FROM r WHERE rank > 2 AND rank <= 5""",
    "vector_normalize": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM chunk_vectors
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0)
        SELECT DISTINCT vec_id, CASE WHEN l > 0 THEN round(sqrt(list_sum(list_transform(x, lambda y: (y / l) * (y / l)))), 6) ELSE 0.0 END::DOUBLE AS norm, CASE WHEN l > 0 THEN round(x[1] / l, 6) ELSE 0.0 END::DOUBLE AS first FROM v""",
    "pairwise_similarity_edges": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.id < b.id)
        SELECT a, b, round(c, 6) AS similarity FROM p WHERE c > 0.3""",
    "bm25_topk": f"""WITH {bm25('SELECT item_id AS query_id, text FROM eval_items')}
        SELECT query_id, id, round(score, 4) AS score FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 5""",
    "hybrid_search": rf"""WITH {VHITS}, {bm25("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL")},
        kw AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM score QUALIFY rank <= 10),
        f AS (SELECT query_id, id, coalesce(0.5 / (60 + hits.rank), 0) + coalesce(0.5 / (60 + kw.rank), 0) AS score FROM hits FULL JOIN kw USING (query_id, id))
        SELECT query_id, id, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 10""",
    "graph_augmented_search": f"""WITH {NL}, {EL}, {INC}, {CTX}, {VHITS},
        m AS (SELECT DISTINCT doc_id AS query_id, lower(ctx.text) AS m, type FROM ctx JOIN documents USING (document_id) WHERE doc_id % 20 = 0),
        fd AS (SELECT query_id, node_id FROM m JOIN n ON n.type = m.type AND contains(lower(n.text), m.m)
          QUALIFY row_number() OVER (PARTITION BY query_id, m.m, m.type ORDER BY coalesce(occurrences, 0) DESC, node_id) <= 5),
        nr AS (SELECT DISTINCT query_id, node_id FROM fd),
        dc AS (SELECT query_id, document_id, max(confidence) AS confidence FROM (SELECT query_id, confidence, unnest(o.documents) AS document_id FROM nr JOIN inc ON inc.node_id = nr.node_id AND inc.confidence >= 0.5
          JOIN n o ON o.node_id = inc.neighbour_id) WHERE document_id IS NOT NULL GROUP BY ALL),
        b AS (SELECT query_id, id AS document_id, 'vector' AS result_type, 0 AS part, rank::DOUBLE AS o FROM hits
          UNION ALL SELECT query_id, document_id, 'knowledge_graph', 1, -confidence FROM dc WHERE query_id IN (SELECT query_id FROM hits) AND (query_id, document_id) NOT IN (SELECT query_id, id FROM hits))
        SELECT query_id, document_id, result_type, row_number() OVER (PARTITION BY query_id ORDER BY part, o, document_id) AS rank FROM b QUALIFY rank <= 20""",
    "export_network_nodes": f"""WITH {NL} SELECT node_id AS id, text AS label, type AS "group", occurrences,
        array_to_string(list_sort(list_filter(list_distinct(coalesce(documents, [])), lambda x: x IS NOT NULL)), ',') AS documents FROM n""",
    "export_network_edges": f"""WITH {NL}, {EL}, {NAMED} SELECT edge_id AS id, source_id AS source, target_id AS target, type AS label, source_text AS "sourceNode", target_text AS "targetNode" FROM named""",
}
