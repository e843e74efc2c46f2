"""Hashes, comparisons and assertions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import integrity as i
from tessera.operators import questions as q
from tessera.plans.catalog import CATALOGUE_SQL, catalogue, table
from tessera.plans.registry import Book

BOOK = Book()


@BOOK.add("""SELECT n_nationkey AS id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS row_hash FROM nation""")
def hash_rows(spark, sf_dir):
    """H2, H3, K9."""
    rows = table(spark, sf_dir, "nation")
    return rows.select(F.col("n_nationkey").alias("id"), i.row_hash(rows.columns).alias("row_hash"))


@BOOK.add("""WITH f AS (SELECT 'docs/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS b FROM documents)
SELECT sha256(string_agg(path || chr(0) || h || chr(10), '' ORDER BY path)) AS sha256, count(*) AS file_count, CAST(sum(b) AS BIGINT) AS bytes FROM f""")
def hash_tree(spark, sf_dir):
    """Every text a file of a tree."""
    text = F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return i.tree_hash(table(spark, sf_dir, "documents").select(path.alias("path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes")))


@BOOK.add("""WITH x AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 11 <> 0),
y AS (SELECT o_orderkey AS id, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE 1e-7 END AS v, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(x.id, y.id) AS id, 'row' AS field FROM x FULL JOIN y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL
UNION ALL SELECT x.id, 's' FROM x JOIN y USING (id) WHERE x.s <> y.s
UNION ALL SELECT x.id, 'v' FROM x JOIN y USING (id) WHERE abs(x.v - y.v) > greatest(1e-9, 1e-9 * greatest(abs(x.v), abs(y.v)))""")
def compare_rows(spark, sf_dir):
    """Rows against rows, with a tolerance."""
    k = F.col("id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    moved = rows.where(k % 13 != 0).withColumns({"v": F.col("v") + F.when(k % 5 == 0, 1.0).otherwise(1e-7), "s": F.when(k % 7 == 0, "X").otherwise(F.col("s"))})
    return i.differing(rows.where(k % 11 != 0), moved, ["id"], ["s"], {"v": 1e-9}).select("id", "field")


@BOOK.add("SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    """Exact duplicate detection."""
    return i.repeated_keys(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash")), ["text_hash"])


@BOOK.add("SELECT conv_id AS id, count(DISTINCT text) AS n FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(DISTINCT text) > 1")
def uneven_questions(spark, sf_dir):
    """Ids with more than one distinct question."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return i.uneven_questions(rows.select(F.col("conv_id").alias("id"), F.col("text").alias("query")))


@BOOK.add("SELECT o_orderpriority AS type, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <> 3000")
def type_balance(spark, sf_dir):
    """A13."""
    return i.type_balance(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type")), 3000)


@BOOK.add(f"""WITH {CATALOGUE_SQL} SELECT 'trade_T1_' || id AS id, 'category' AS reason FROM n WHERE id % 5 = 0
UNION ALL SELECT 'trade_T2_' || id, 'prerequisites' FROM n WHERE id % 3 = 0 AND len(deps) > 0
UNION ALL SELECT 'trade_T3_1_' || id, 'path labels' FROM n WHERE id % 6 = 1 AND (tax = 'SPON' OR tax = 'COND' AND id NOT IN (SELECT dst FROM e))
UNION ALL SELECT 'trade_T5_' || src || '_' || dst, x FROM e, (VALUES ('edge'), ('labels')) v(x) WHERE src % 4 = 0
UNION ALL SELECT 'trade_T5_' || src || '_' || dst, 'labels' FROM e WHERE src % 4 = 1""")
def ungrounded_answers(spark, sf_dir):
    """Damaged answers are found; sound ones, also in other orders and cases, pass."""
    nodes = catalogue(spark, sf_dir)
    edges = g.edges_of(nodes)
    asked = q.generate(nodes, edges)
    kind, truth = F.col("type"), F.col("ground_truth")
    t1 = (kind == "T1_entity") & (F.col("concept_id") % 5 == 0)
    t2 = (kind == "T2_dependency") & (F.col("concept_id") % 3 == 0)
    t3 = (kind == "T3_path") & (F.col("concept_id") % 6 == 1)
    t5 = kind == "T5_cross_concept"
    said = F.when(t1 | t2, F.array(F.lit("wrong"))).when(t3, F.reverse(truth)).when(kind == "T4_aggregate", F.reverse(truth)).when(kind == "T2_dependency", F.transform(truth, F.upper))
    said = said.when(t5 & (F.col("concept_id_a") % 4 == 1), F.reverse(truth)).otherwise(truth)
    lost = t5 & (F.col("concept_id_a") % 4 == 0)
    damaged = asked.withColumns({"ground_truth": said, "concept_id_b": F.when(lost, F.lit(-1)).otherwise(F.col("concept_id_b"))})
    return i.ungrounded(damaged, nodes, edges)


@BOOK.add(f"""WITH {CATALOGUE_SQL} SELECT 'hop_depth' AS key, count(*) AS n FROM n WHERE id % 3 = 0 UNION ALL SELECT 'ground_truth', count(*) FROM n WHERE id % 4 = 0""")
def leaked_keys(spark, sf_dir):
    """H9: documents that hold what only the answer key may."""
    k = F.col("id")
    text = F.to_json(F.struct("label", F.when(k % 3 == 0, F.lit(1)).alias("hop_depth"), F.when(k % 4 == 0, F.array("label")).alias("ground_truth")))
    return i.leaked(catalogue(spark, sf_dir).select(text.alias("document")))
