"""Readers of graphs, questions, result rows, documents and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t

QUESTION_SCHEMA = (
    "id string, domain string, type string, query_type string, query string, ground_truth array<string>, hop_depth int, "
    "concept_id long, path_ids array<long>, taxonomy_id string, concept_id_a long, concept_id_b long"
)


def domain_of(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def dependency_list(cell: Column, strict: bool = False) -> Column:
    """The ids in a ``|``-joined cell.

    Tokens that are no number are dropped; ``strict`` makes them an error.
    """
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), lambda x: F.trim(x))
    kept = F.filter(parts, (lambda x: x != "") if strict else (lambda x: x.rlike("^[0-9]+$")))
    return F.transform(kept, lambda x: x.cast("long"))


def read_graphs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The node table (graph.NODE_SCHEMA) of CSV files, one folder a domain.

    A file without a TaxonomyID column gives ``GEN`` unless ``strict``; a blank
    cell stays empty.  Of rows
    that repeat an id the last gives the values, the first the place.  A
    file's order is that of its lines: files are read whole, one task each.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    code = F.col("TaxonomyID") if "TaxonomyID" in raw.columns else F.lit("GEN")
    if strict and "TaxonomyID" not in raw.columns:
        raise ValueError("no TaxonomyID column")
    rows = raw.select(
        domain_of(F.col("_metadata.file_path")).alias("domain"), F.trim("ConceptID").cast("long").alias("id"), F.trim("ConceptLabel").alias("label"),
        dependency_list(F.col("Dependencies"), strict).alias("dependencies"), F.coalesce(F.trim(code), F.lit("")).alias("taxonomy_id"), F.monotonically_increasing_id().alias("ord"),
    )
    last = F.max_by(F.struct("label", "dependencies", "taxonomy_id"), "ord")
    return rows.groupBy("domain", "id").agg(last.alias("x"), F.min("ord").alias("ord")).select("domain", "id", "x.label", "x.dependencies", "x.taxonomy_id", "ord")


def read_questions(spark: SparkSession, path: str, schema: str = QUESTION_SCHEMA) -> DataFrame:
    """Question rows of JSON-lines files; blank lines are skipped; the type may be under either name."""
    return spark.read.schema(schema).json(path).withColumn("type", F.coalesce("query_type", "type", F.lit(""))).drop("query_type")


def read_rows(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON-lines rows with the file they come from; ``tolerant`` drops broken lines, else they are an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document in one or many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_markdown(spark: SparkSession, path: str, careful: bool = True, least: int = 200) -> DataFrame:
    """domain, source, text of a Markdown corpus ``<domain>/docs/...``, without markup.

    Texts of ``least`` characters or fewer after stripping are left out.
    ``careful`` keeps ``<`` in prose; the other filter drops whatever looks like a tag.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    strip = t.strip_markup_carefully if careful else t.strip_markup
    rows = raw.select(F.regexp_extract(name, r"([^/]+)/docs/", 1).alias("domain"), F.regexp_extract(name, r"/docs/(.+)$", 1).alias("source"), strip(F.col("value")).alias("text"))
    wanted = F.col("source").rlike(r"^(chapters/[^/]+/index\.md|glossary\.md|course-description\.md)$")
    return rows.where(wanted & (F.length("text") > least))


def read_hashes(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """path (below ``root``), sha256 and bytes of every file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_replace("path", f"^.*?{root}/", "").alias("path") if root else F.col("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def select_domains(manifest: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Rows of a domain manifest; a repeated id or an unknown wanted one is an error."""
    again = [r["id"] for r in manifest.groupBy("id").count().where("count > 1").orderBy("id").limit(10).collect()]
    if again:
        raise ValueError(f"repeated domains: {again}")
    if ids is None:
        return manifest
    wanted = manifest.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    lost = [r["id"] for r in wanted.join(manifest, "id", "left_anti").orderBy("id").limit(10).collect()]
    if lost:
        raise ValueError(f"unknown domains: {lost}")
    return manifest.join(wanted, "id", "left_semi")
