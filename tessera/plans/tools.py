"""Seven look-ups for callers who ask one thing at a time; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as g


def list_domains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, nodes, edges."""
    return nodes.groupBy("domain").agg(F.count("*").alias("nodes")).join(edges.groupBy("domain").agg(F.count("*").alias("edges")), "domain", "left").na.fill(0, ["edges"])


def search_concepts(nodes: DataFrame, text: str | None = None, taxonomy_id: str | None = None, domain: str | None = None) -> DataFrame:
    """Nodes whose label holds the text, in any case, of a category and domain if given."""
    out = nodes
    if text:
        out = out.where(F.contains(F.lower("label"), F.lit(text.lower())))
    if taxonomy_id:
        out = out.where(F.upper("taxonomy_id") == taxonomy_id.upper())
    return out.where(F.col("domain") == domain) if domain else out


def get_relationship_context(nodes: DataFrame, edges: DataFrame, domain: str, concept: str) -> DataFrame:
    """direction, label, taxonomy_id: what the named concept depends on and what depends on it."""
    asked = nodes.sparkSession.createDataFrame([(domain, 1, concept)], "domain string, key int, text string")
    found = g.resolve(asked, nodes.where(F.col("domain") == domain)).select(F.lit(domain).alias("domain"), F.col("node").alias("id"))
    named = nodes.select("domain", F.col("id").alias("other"), "label", "taxonomy_id")
    out = edges.join(found.withColumnRenamed("id", "src"), ["domain", "src"]).select("domain", F.col("dst").alias("other"), F.lit("depends on").alias("direction"), "pos")
    back = edges.join(found.withColumnRenamed("id", "dst"), ["domain", "dst"]).select("domain", F.col("src").alias("other"), F.lit("needed by").alias("direction"), F.col("src").alias("pos"))
    return out.unionAll(back).join(named, ["domain", "other"]).orderBy("direction", "pos").select("direction", "label", "taxonomy_id")


def get_query(questions: DataFrame, question_id: str) -> DataFrame:
    return questions.where(F.col("id") == question_id)


def compare_system_outputs(rows: DataFrame, question_id: str) -> DataFrame:
    """Each system's answer to one question, best score first."""
    return rows.where(F.col("id") == question_id).orderBy(F.desc("f1"), "system")


def summarize_benchmark_result(rows: DataFrame, domain: str | None = None) -> DataFrame:
    """The summary of all rows, or of one domain's."""
    from tessera.operators.rollup import summary

    out = summary(rows)
    return out.where(F.col("domain") == domain) if domain else out.where(F.col("type").isNull() & F.col("domain").isNull())


def explain_scope_and_limitations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the loaded graphs cover, counted, with the limits of what they can say."""
    note = "Answers cover the loaded graphs only; labels and dependencies are as recorded, not clinical advice."
    return nodes.groupBy("taxonomy_id").agg(F.count("*").alias("nodes"), F.count_distinct("domain").alias("domains")).withColumn("note", F.lit(note))
