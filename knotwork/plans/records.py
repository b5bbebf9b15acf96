"""Registered queries of the core data-quality operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import nested, orphans
from knotwork.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"))
    return found.select("edge_id", "ref_field")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"))
    return orphans.orphan_report(found, "edges")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.element_paths(table(spark, sf_dir, "nodes"))


def p5_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nested.latest_rows(table(spark, sf_dir, "nodes"), "node_id", "ingested_at", ["contexts"])
    rows = nested.array_rows(last, "node_id", "contexts")
    return rows.select("node_id", "path", F.col("ordinal").cast("long").alias("ordinal"), "value.*")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = nested.latest_rows(table(spark, sf_dir, "nodes"), "node_id", "ingested_at", ["metadata"])
    decoded, depth = nested.decoded_records(last, "node_id", "metadata")
    return nested.child_records(decoded, "node_id", "metadata", depth)


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nested.merged_schema(_records(spark, sf_dir))
    return s.select("pattern", "field", F.array_join("types", ",").alias("types"), "n_rows")


def p5_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_rows(_records(spark, sf_dir), "node_id").withColumn("ordinal", F.col("ordinal").cast("long"))


def p5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.child_table(_records(spark, sf_dir), "node_id", "metadata.sources[].spans[]", ["start", "end", "label"])
    return rows.withColumn("ordinal", F.col("ordinal").cast("long"))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p5_found": p5_found,
    "p5_contexts": p5_contexts,
    "p5_schema": p5_schema,
    "p5_children": p5_children,
    "p5_spans": p5_spans,
}

_JUDGED = r"""
first AS (
  SELECT edge_id, source_id, target_id, ingested_at AS t FROM edges
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at) = 1),
refs AS (
  SELECT edge_id, 'source_id' AS ref_field, lower(regexp_replace(source_id, '^\s+|\s+$', '', 'g')) AS ref, t FROM first
  UNION ALL
  SELECT edge_id, 'target_id', lower(regexp_replace(target_id, '^\s+|\s+$', '', 'g')), t FROM first),
judged AS (
  SELECT r.edge_id, r.ref_field, r.ref, r.t, count(n.node_id) AS n_rows,
         arg_max(struct_pack(gone := n.deleted_at), n.ingested_at).gone <= r.t AS gone
  FROM refs r LEFT JOIN nodes n ON n.node_id = r.ref AND n.ingested_at <= r.t
  WHERE r.ref <> '' GROUP BY r.edge_id, r.ref_field, r.ref, r.t),
orphans AS (SELECT * FROM judged WHERE n_rows = 0 OR coalesce(gone, false))
"""

# every value of the latest metadata of a node with its path, the nearest enclosing object and its place in an array;
# a string that encodes an object, array or string gives a second row of the same path for what it encodes
_UNFOLDED = """
        last AS (SELECT node_id, documents, contexts, metadata FROM nodes
          QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) = 1),
        r AS (
          SELECT node_id, 'metadata' AS path, NULL::VARCHAR AS parent, NULL::BIGINT AS ordinal, metadata::JSON AS v, json_type(metadata) AS t
          FROM last WHERE json_valid(metadata)
          UNION ALL
          SELECT node_id, CASE WHEN t = 'OBJECT' THEN path || '.' || c.key WHEN t = 'ARRAY' THEN path || '[' || c.key || ']' ELSE path END,
            CASE WHEN t = 'OBJECT' THEN path ELSE parent END,
            CASE WHEN t = 'ARRAY' THEN c.key::BIGINT WHEN t = 'OBJECT' THEN NULL ELSE ordinal END, c.value, json_type(c.value)
          FROM r, LATERAL (
            SELECT j.key, j.value FROM json_each(r.v) j WHERE r.t IN ('OBJECT', 'ARRAY')
            UNION ALL SELECT NULL, (r.v ->> '$')::JSON WHERE CASE WHEN r.t = 'VARCHAR' AND json_valid(r.v ->> '$')
              THEN json_type(r.v ->> '$') IN ('OBJECT', 'ARRAY', 'VARCHAR') ELSE false END) c)"""
# the fields of every object and the other array elements, each with what it finally encodes
_PARTS = r"""
        final AS (SELECT * FROM r WHERE NOT (t = 'VARCHAR' AND json_valid(v ->> '$') AND CASE WHEN json_valid(v ->> '$') THEN json_type(v ->> '$') IN ('OBJECT', 'ARRAY', 'VARCHAR') ELSE false END)),
        recs AS (SELECT * FROM final WHERE t = 'OBJECT' OR (ordinal IS NOT NULL AND t NOT IN ('NULL', 'ARRAY'))),
        kids AS (SELECT node_id, parent, path, v, t FROM final WHERE ordinal IS NULL AND parent IS NOT NULL),
        named AS (SELECT x.node_id, x.path, x.parent, x.ordinal, x.v, x.t, substr(k.path, length(x.path) + 2) AS field, k.v AS fv, k.t AS ft
          FROM recs x LEFT JOIN kids k ON k.node_id = x.node_id AND k.parent = x.path AND x.t = 'OBJECT'),
        raw AS (SELECT node_id, path, parent, ordinal, v, t, field, CASE WHEN t = 'OBJECT' THEN fv ELSE v END AS fv, CASE WHEN t = 'OBJECT' THEN ft ELSE t END AS ft FROM named),
        parts AS (SELECT *, regexp_replace('.' || regexp_replace(path, '\[\d+\]', '[]', 'g'), '\.[^.\[\]]*\d{4,}[^.\[\]]*', '.*', 'g')[2:] AS pattern FROM raw)"""

ORACLE = {
    "p2_found": f"WITH {_JUDGED} SELECT edge_id, ref_field FROM orphans",
    "p2_report": f"""WITH {_JUDGED}
        SELECT 'edges' AS table_name, ref_field, strftime(t, '%Y-%m') AS period,
          CASE WHEN n_rows > 0 THEN 'deleted'
               WHEN ref IN (SELECT node_id FROM nodes) THEN 'late' ELSE 'missing' END AS reason,
          count(*) AS n_refs
        FROM orphans GROUP BY ALL""",
    "p5_found": f"""
        WITH RECURSIVE {_UNFOLDED}
        SELECT node_id, path FROM r WHERE t = 'OBJECT' AND path <> 'metadata'
        UNION ALL SELECT node_id, 'documents[' || i || ']' FROM (
          SELECT node_id, unnest(documents) AS d, generate_subscripts(documents, 1) - 1 AS i FROM last) WHERE d IS NOT NULL
        UNION ALL SELECT node_id, 'contexts[' || i || ']' FROM (
          SELECT node_id, unnest(contexts) AS d, generate_subscripts(contexts, 1) - 1 AS i FROM last) WHERE d IS NOT NULL""",
    "p5_schema": f"""
        WITH RECURSIVE {_UNFOLDED}, {_PARTS},
        typed AS (SELECT pattern, CASE WHEN regexp_matches(field, '[0-9]{{4,}}') THEN '*' ELSE field END AS field,
          CASE ft WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE ft END AS kind FROM parts)
        SELECT pattern, field, array_to_string(list_sort(list_distinct(list(kind))), ',') AS types, count(*) AS n_rows FROM typed GROUP BY ALL""",
    "p5_children": f"""
        WITH RECURSIVE {_UNFOLDED}, {_PARTS}
        SELECT md5(node_id || '|' || path) AS record_key, CASE WHEN path <> 'metadata' THEN md5(node_id || '|' || coalesce(parent, 'metadata')) END AS parent_key,
          node_id, path, pattern, ordinal, field, CASE WHEN ft = 'DOUBLE' THEN regexp_replace(regexp_replace(fv ->> '$', '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') WHEN ft NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN fv ->> '$' END AS value FROM parts""",
    "p5_spans": f"""
        WITH RECURSIVE {_UNFOLDED}, {_PARTS}, s AS (SELECT DISTINCT node_id, path, parent, ordinal, v FROM parts WHERE pattern = 'metadata.sources[].spans[]' AND t = 'OBJECT')
        SELECT md5(node_id || '|' || path) AS record_key, md5(node_id || '|' || coalesce(parent, 'metadata')) AS parent_key, node_id, path, ordinal,
          v ->> '$.start' AS start, v ->> '$.end' AS "end", v ->> '$.label' AS label FROM s""",
    "p5_contexts": """
        WITH last AS (SELECT node_id, contexts FROM nodes
          QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ingested_at DESC) = 1),
        rows AS (SELECT node_id, unnest(contexts) AS c, generate_subscripts(contexts, 1) - 1 AS ordinal FROM last)
        SELECT node_id, 'contexts[' || ordinal || ']' AS path, ordinal,
          c.document AS document, c.start_pos AS start_pos, c.end_pos AS end_pos
        FROM rows WHERE c IS NOT NULL""",
}
