"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import drift, flatten, hierarchy
from packetloom.runtime import cut, first_rows, read_table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_level(p3_scripts(spark, sf)).select("project_key", "file_no", "change_kind", "field", "new_field")


def p3_unified(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unify(read_table(spark, sf, "transcript_lines"), read_table(spark, sf, "field_catalog"))


def p3_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, sf, "transcript_lines")).drop("old_path", "new_path")


def _links(spark: SparkSession, sf: str) -> DataFrame:
    c = first_rows(read_table(spark, sf, "claude_rows").select("session_id", "line_no", "uuid", "parentUuid", "received_at"), ["session_id", "line_no"])
    p = first_rows(read_table(spark, sf, "pi_rows").select("session_id", "row_no", "id", "parentId", "received_at"), ["session_id", "row_no"])
    c = c.select(F.concat(F.lit("claude_rows\t"), "session_id").alias("scope"), F.col("uuid").alias("id"), F.col("parentUuid").alias("parent"), F.col("line_no").alias("pos"))
    p = p.select(F.concat(F.lit("pi_rows\t"), "session_id").alias("scope"), "id", F.col("parentId").alias("parent"), F.col("row_no").alias("pos"))
    return c.unionByName(p)


def _scoped(df: DataFrame) -> list:
    part = F.split(df["scope"], "\t", 2)
    return [part[0].alias("tbl"), part[1].alias("session_id")]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    t = hierarchy.resolve_hierarchy(_links(spark, sf), paths=False).filter(F.col("state").isin("orphan", "cycle", "below_cycle"))
    return t.select(*_scoped(t), F.col("id").alias("node_id"), F.col("state").alias("case_kind"))


def p5_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Paths, depths, roots and descendants: their number and, off loops, their preorder interval in the root's tree."""
    links = _links(spark, sf)
    t = cut(hierarchy.resolve_hierarchy(links, sums=True))
    n = hierarchy.loop_counts(links, t)
    t = t.join(n, ["scope", "id"], "left").join(hierarchy.preorder(t), ["scope", "id"], "left")
    count = F.coalesce("n", F.col("total") - 1).alias("n_descendants")
    return t.select(*_scoped(t), F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "state", "depth", F.col("root").alias("root_id"), "path", count, F.col("first").alias("preorder"), F.col("last").alias("last_descendant"))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    d = hierarchy.descendants(hierarchy.resolve_hierarchy(_links(spark, sf)))
    return d.select(*_scoped(d), F.col("ancestor").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p5_loop_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs on and below loops, which the SQL of p5_descendants leaves out."""
    links = _links(spark, sf)
    d = hierarchy.loop_descendants(links, cut(hierarchy.resolve_hierarchy(links, paths=False)))
    return d.select(*_scoped(d), F.col("ancestor").alias("node_id"), F.col("descendant").alias("descendant_id"), "distance")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.flatten_records(read_table(spark, sf, "claude_rows")).select("session_id", "line_no", "rel", "item_no", "sub_no")


def p6_tables(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.tables(read_table(spark, sf, "claude_rows"))


QUERIES = {f.__name__: f for f in (p3_found, p3_unified, p3_scripts, p5_found, p5_tree, p5_descendants, p5_loop_descendants, p6_found, p6_tables)}

#: session, node and parent of both tables, a node's first row counts
_P5_NODES = """n AS (SELECT tbl, session_id, id, (min({'pos': pos, 'parent': coalesce(parent, '')})).parent AS parent0, min(pos) AS pos FROM (
  SELECT 'claude_rows' AS tbl, session_id, uuid AS id, parentUuid AS parent, line_no AS pos FROM claude_rows WHERE uuid IS NOT NULL
  UNION ALL SELECT 'pi_rows', session_id, id, parentId, row_no FROM pi_rows WHERE id IS NOT NULL) GROUP BY ALL),
 m AS (SELECT tbl, session_id, id, nullif(parent0, '') AS parent FROM n)"""

ORACLE = {
    "p5_found": f"""WITH RECURSIVE {_P5_NODES},
 e AS (SELECT m.tbl, m.session_id, m.id, m.parent FROM m JOIN m u ON m.tbl=u.tbl AND m.session_id=u.session_id AND m.parent=u.id),
 up AS (SELECT tbl, session_id, id, parent AS anc FROM e UNION SELECT up.tbl, up.session_id, up.id, e.parent FROM up JOIN e ON up.tbl=e.tbl AND up.session_id=e.session_id AND up.anc=e.id),
 c AS (SELECT tbl, session_id, id FROM up WHERE id=anc)
 SELECT tbl, session_id, id AS node_id, 'orphan' AS case_kind FROM m WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m u WHERE m.tbl=u.tbl AND m.session_id=u.session_id AND m.parent=u.id)
 UNION ALL SELECT tbl, session_id, id, 'cycle' FROM c
 UNION ALL SELECT DISTINCT up.tbl, up.session_id, up.id, 'below_cycle' FROM up JOIN c ON up.tbl=c.tbl AND up.session_id=c.session_id AND up.anc=c.id WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.tbl=up.tbl AND o.session_id=up.session_id AND o.id=up.id)""",
    "p5_descendants": f"""WITH RECURSIVE {_P5_NODES},
 tops AS (SELECT m.* FROM m LEFT JOIN m u ON m.tbl=u.tbl AND m.session_id=u.session_id AND m.parent=u.id WHERE u.id IS NULL),
 w AS (SELECT tbl, session_id, id, [id] AS path FROM tops UNION ALL
   SELECT m.tbl, m.session_id, m.id, list_append(w.path, m.id) FROM m JOIN w ON m.tbl=w.tbl AND m.session_id=w.session_id AND m.parent=w.id)
 SELECT tbl, session_id, path[i] AS node_id, id AS descendant_id, CAST(len(path)-i AS BIGINT) AS distance FROM (SELECT *, unnest(range(1, len(path))) AS i FROM w)""",
}
