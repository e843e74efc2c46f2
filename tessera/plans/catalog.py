"""The driver's tables seen as the engine's inputs: a typed graph, texts, queries.

Every view exists twice, as a DataFrame and as the SQL of a common table
expression, so that queries and their checks start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN = "trade"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, id_, label, deps, code: str) -> DataFrame:
    ids = F.array(*[d.cast("long") for d in deps]) if deps else F.array().cast("array<long>")
    return df.select(F.lit(DOMAIN).alias("domain"), id_.cast("long").alias("id"), label.alias("label"), ids.alias("dependencies"), F.lit(code).alias("taxonomy_id")).withColumn("ord", F.col("id"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of regions, nations and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    root = _nodes(spark.range(1), F.lit(1), F.lit("Trade landscape"), [], "AREA")
    region = _nodes(t("region"), 10 + F.col("r_regionkey"), F.concat("r_name", F.lit(" region")), [F.lit(1)], "FRAME")
    nation = _nodes(t("nation"), 100 + F.col("n_nationkey"), F.concat("n_name", F.lit(" nation")), [10 + F.col("n_regionkey")], "COND")
    supplier = _nodes(t("supplier"), 1000 + F.col("s_suppkey"), F.col("s_name"), [100 + F.col("s_nationkey")], "SPON")
    return root.unionAll(region).unionAll(nation).unionAll(supplier)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with statuses, priorities and one node for each order."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    status_id, phase_id = 50 + F.ascii("o_orderstatus") - 65, 80 + F.substring("o_orderpriority", 1, 1).cast("int")
    status = _nodes(orders.select("o_orderstatus").distinct(), status_id, F.concat(F.lit("Status "), "o_orderstatus"), [F.lit(1)], "STATUS")
    phase = _nodes(orders.select("o_orderpriority").distinct(), phase_id, F.col("o_orderpriority"), [F.lit(1)], "PHASE")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    label = F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(" order"))
    trial = _nodes(placed, 10_000_000 + F.col("o_orderkey"), label, [100 + F.col("c_nationkey"), status_id, phase_id], "TRIAL")
    return catalogue(spark, sf_dir).unionAll(status).unionAll(phase).unionAll(trial)


#: An id that is no node.
ABSENT = 99


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trials`` as hand-made files have them: some nodes repeat a dependency and name a node that is not there."""
    nodes = trials(spark, sf_dir)
    some = (F.col("id") % 3 != 2) & F.col("taxonomy_id").isin("SPON", "TRIAL")
    more = F.concat("dependencies", F.array(F.lit(ABSENT).cast("long"), F.element_at("dependencies", 1)))
    return nodes.withColumn("dependencies", F.when(some, more).otherwise(F.col("dependencies")))


_CATALOGUE = """
  SELECT 1::BIGINT AS id, 'Trade landscape' AS label, CAST([] AS BIGINT[]) AS deps, 'AREA' AS tax
  UNION ALL SELECT 10 + r_regionkey, r_name || ' region', [1::BIGINT], 'FRAME' FROM region
  UNION ALL SELECT 100 + n_nationkey, n_name || ' nation', [(10 + n_regionkey)::BIGINT], 'COND' FROM nation
  UNION ALL SELECT 1000 + s_suppkey, s_name, [(100 + s_nationkey)::BIGINT], 'SPON' FROM supplier"""
_TRIALS = """
  UNION ALL SELECT DISTINCT 50 + ascii(o_orderstatus) - 65, 'Status ' || o_orderstatus, [1::BIGINT], 'STATUS' FROM orders
  UNION ALL SELECT DISTINCT 80 + CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderpriority, [1::BIGINT], 'PHASE' FROM orders
  UNION ALL SELECT 10000000 + o_orderkey, 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || ' order',
    [(100 + c_nationkey)::BIGINT, (50 + ascii(o_orderstatus) - 65)::BIGINT, (80 + CAST(substr(o_orderpriority, 1, 1) AS INT))::BIGINT], 'TRIAL'
    FROM orders JOIN customer ON o_custkey = c_custkey"""
_EDGES = ", e AS (SELECT id AS src, unnest(deps) AS dst, CAST(unnest(range(0, len(deps))) AS BIGINT) AS pos FROM n)"
#: CTEs ``n`` (id, label, deps, tax) and ``e`` (src, dst, pos).
CATALOGUE_SQL = f"n AS ({_CATALOGUE}){_EDGES}"
TRIALS_SQL = f"n AS ({_CATALOGUE}{_TRIALS}){_EDGES}"
#: Also ``k``, the edges between nodes.
FLAWED_SQL = f"""t AS ({_CATALOGUE}{_TRIALS}),
n AS (SELECT id, label, CASE WHEN id % 3 <> 2 AND tax IN ('SPON', 'TRIAL') THEN deps || [{ABSENT}::BIGINT, deps[1]] ELSE deps END AS deps, tax FROM t){_EDGES},
k AS (SELECT src, dst, pos FROM e WHERE dst IN (SELECT id FROM n))"""
