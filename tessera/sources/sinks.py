"""Writers of graphs, rows, questions and Markdown; each through Spark's own commit protocol."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(rows: DataFrame, path: str, by: Sequence[str] = ("system", "domain"), replace: bool = False) -> None:
    """JSON lines, keys in alphabetical order, a folder for each system and domain.

    Refuses a folder that exists unless ``replace``, which swaps the
    partitions that ``rows`` has and keeps the others.
    """
    ordered = rows.select(*sorted(c for c in rows.columns if c not in by), *by)
    writer = ordered.write.partitionBy(*by)
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.json(path)


def merge_rows(old: DataFrame, new: DataFrame, key: str = "type") -> DataFrame:
    """``old`` without the types that ``new`` has, and ``new``: a rerun of a type replaces only that type."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def finished(rows: DataFrame) -> bool:
    """Whether an earlier run spent any tokens, so that it can be kept."""
    return not rows.where("total_tokens > 0").isEmpty()


def _placed(spark: SparkSession, staged: str, files: dict[int, str]) -> None:
    """Moves the one part file under ``staged/file=N`` to the path of N, for every N, and removes ``staged``.

    One rename for each file that is published, through the file system's own interface.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for n, target in files.items():
        part = fs.globStatus(hadoop.Path(f"{staged}/file={n}/part-*"))
        fs.mkdirs(hadoop.Path(target).getParent())
        if not part or not fs.rename(part[0].getPath(), hadoop.Path(target)):
            raise OSError(f"cannot write {target}")
    fs.delete(hadoop.Path(staged), True)


def write_graph(nodes: DataFrame, path: str, name: str = "learning-graph.csv") -> None:
    """``<domain>/learning-graph.csv`` for each domain; dependencies sorted, distinct, ``|``-joined."""
    domains = [r[0] for r in nodes.select("domain").distinct().orderBy("domain").collect()]  # one file each
    number = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i))]) if domains else None
    deps = F.array_join(F.transform(F.array_sort(F.array_distinct("dependencies")), lambda x: x.cast("string")), "|")
    rows = nodes.select((number[F.col("domain")] if domains else F.lit(0)).alias("file"), F.col("id").alias("ConceptID"), F.col("label").alias("ConceptLabel"), deps.alias("Dependencies"), F.col("taxonomy_id").alias("TaxonomyID"))
    writer = rows.repartition("file").sortWithinPartitions("file", "ConceptID").write.partitionBy("file")
    writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{path}/_staged")
    _placed(nodes.sparkSession, f"{path}/_staged", {i: f"{path}/{d}/{name}" for i, d in enumerate(domains)})


def write_chapters(trials: DataFrame, domain: dict, path: str) -> int:
    """The Markdown corpus of one domain: ``<id>/docs/course-description.md`` and a
    chapter for each search term, ``<id>/docs/chapters/NN-term/index.md``.

    ``domain``: id, label, rationale, description, queries (dicts of field and term).  A
    chapter holds the trials found by its term in the order of their numbers;
    lines are sorted, not gathered.  Returns the number of chapters.
    """
    from tessera.functions.text import slugify
    from tessera.operators.build import trial_markdown

    spark = trials.sparkSession
    terms = [(i, q["field"], q["term"]) for i, q in enumerate(domain["queries"], 1)]
    listed = spark.createDataFrame(terms, "file int, field string, term string")
    found = trials.select("nct_id", F.explode(F.array_distinct("search_terms")).alias("term")).join(listed, "term").select("file", "nct_id")
    rows = trial_markdown(trials).join(found, "nct_id").select("file", "nct_id", F.col("markdown").alias("value"))
    counts = listed.join(rows.groupBy("file").count(), "file", "left").na.fill(0, ["count"])
    said = [F.lit(f"# {domain['label']}: "), F.col("term"), F.lit("\n\nSource: ClinicalTrials.gov API v2, "), F.col("field"), F.lit("="), F.col("term"), F.lit("\nTrial count in this chapter: "), F.col("count").cast("string")]
    heads = counts.select("file", F.lit("").alias("nct_id"), F.concat(*said).alias("value"))
    about = [f"# {domain['label']} ClinicalTrials.gov Corpus", "", domain.get("description", "Public ClinicalTrials.gov API v2 records, normalized."), "", f"Domain id: {domain['id']}", f"Rationale: {domain.get('rationale', '')}", "", "Search terms:"]
    course = spark.createDataFrame([(0, "", "\n".join([*about, *[f"- {f}={t}" for _, f, t in terms]]))], "file int, nct_id string, value string")
    order = ("file", "nct_id")
    # a line break before every trial makes the blank line between them
    parts = course.unionByName(heads).unionByName(rows.withColumn("value", F.concat(F.lit("\n"), "value")))
    parts.repartition("file").sortWithinPartitions(*order).select("file", "value").write.partitionBy("file").text(f"{path}/_staged")
    slugs = {r["file"]: r["slug"] for r in listed.select("file", slugify(F.col("term")).alias("slug")).collect()}  # one for each search term
    docs = f"{path}/{domain['id']}/docs"
    _placed(spark, f"{path}/_staged", {0: f"{docs}/course-description.md"} | {i: f"{docs}/chapters/{i:02d}-{slugs[i]}/index.md" for i in slugs})
    return len(terms)


def write_json(rows: DataFrame, path: str) -> None:
    """Provenance, questions or documents as JSON lines, keys in alphabetical order."""
    rows.select(*sorted(rows.columns)).write.json(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A manifest or aggregate as one JSON document, indented, keys sorted."""
    text = json.dumps(document, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
