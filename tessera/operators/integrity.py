"""Checks that published rows can be rebuilt from what they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's JSON with its keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def tree_hash(files: DataFrame) -> DataFrame:
    """sha256, file_count, bytes of a tree.

    ``files``: path, sha256, bytes.  The digest is over path, zero byte, digest
    and newline of each file by path, a text of about a hundred bytes a file.
    """
    line = F.concat("path", F.lit("\u0000"), "sha256", F.lit("\n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("sha256"), F.count("*").alias("file_count"), F.sum("bytes").alias("bytes"))


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), near: dict[str, float] | None = None) -> DataFrame:
    """Rows of either side that the other lacks or does not equal.

    ``exact`` columns must be equal (null equals null), ``near`` ones within an
    absolute or relative tolerance.  Gives keys, field, left and right as text.
    """
    cols = [*exact, *(near or {})]
    a = left.select(*keys, F.struct(*cols).alias("_l"))
    b = right.select(*keys, F.struct(*cols).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    found = [F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.struct(F.lit("row").alias("field"), F.when(F.col("_l").isNull(), "absent").alias("left"), F.when(F.col("_r").isNull(), "absent").alias("right")))]
    for c in cols:
        x, y = F.col(f"_l.{c}"), F.col(f"_r.{c}")
        if c in (near or {}):
            tol = F.lit((near or {})[c])
            same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= F.greatest(tol, tol * F.greatest(F.abs(x), F.abs(y))), F.lit(False))
        else:
            same = x.eqNullSafe(y)
        present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
        found.append(F.when(present & ~same, F.struct(F.lit(c).alias("field"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    return both.select(*keys, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select(*keys, "d.*")


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def uneven_questions(rows: DataFrame) -> DataFrame:
    """Ids for which systems were asked different questions (id, system, query)."""
    return rows.groupBy("id").agg(F.count_distinct("query").alias("n")).where("n > 1")


def type_balance(rows: DataFrame, per_type: int) -> DataFrame:
    """Types whose number of rows is not the expected one."""
    return rows.groupBy("type").agg(F.count("*").alias("n")).where(F.col("n") != per_type)


def ungrounded(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Questions whose stored answer the graph does not give: id, reason.

    T1: the concept's category; T2: the prerequisites' labels, as a set; T3: the
    labels of the path, in order, and every step a dependency; T4: the
    category's labels, as a set; T5: the pair is a dependency and its labels
    stand in order.  Labels are compared in canonical form; a question about an
    id that is no node is ungrounded.
    """
    from tessera.functions.text import canonical_label
    from tessera.operators.graph import in_order, prerequisites

    plain = lambda c: F.transform(c, canonical_label)
    none = F.array().cast("array<string>")
    as_set = lambda c: F.array_sort(F.array_distinct(F.filter(plain(F.coalesce(c, none)), lambda x: x != "")))
    of = lambda kind: questions.where(F.col("type") == kind)
    wrong = lambda df, same, reason: df.where(~F.coalesce(same, F.lit(False))).select("id", F.lit(reason).alias("reason"))
    named = lambda end, label="_l": nodes.select("domain", F.col("id").alias(end), F.col("label").alias(label))

    own = nodes.select("domain", F.col("id").alias("concept_id"), F.col("taxonomy_id").alias("_code"))
    t1 = wrong(of("T1_entity").join(own, ["domain", "concept_id"], "left"), F.col("_code") == F.element_at("ground_truth", -1), "category")

    needs = prerequisites(nodes, edges).groupBy("domain", F.col("id").alias("concept_id")).agg(F.collect_set("label").alias("_now"))
    t2 = wrong(of("T2_dependency").join(needs, ["domain", "concept_id"], "left"), as_set(F.col("_now")) == as_set(F.col("ground_truth")), "prerequisites")

    paths = of("T3_path").select("id", "domain", "path_ids", "ground_truth")
    steps = paths.select("id", "domain", F.posexplode("path_ids").alias("_p", "member")).join(named("member"), ["domain", "member"], "left")
    told = steps.groupBy("id", "domain").agg(in_order(F.coalesce("_l", F.lit("")), F.col("_p")).alias("_now"))
    t3 = wrong(paths.join(told, ["id", "domain"], "left"), plain(F.col("_now")) == plain(F.col("ground_truth")), "path labels")
    n = F.greatest(F.size("path_ids") - 1, F.lit(0))
    hops = F.zip_with(F.slice("path_ids", F.lit(1), n), F.slice("path_ids", F.lit(2), n), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    t3_steps = paths.select("id", "domain", F.explode(hops).alias("h")).select("id", "domain", "h.*").join(edges, ["domain", "src", "dst"], "left_anti").select("id", F.lit("path").alias("reason")).distinct()

    kinds = nodes.groupBy("domain", "taxonomy_id").agg(F.collect_set("label").alias("_now"))
    t4 = wrong(of("T4_aggregate").join(kinds, ["domain", "taxonomy_id"], "left"), as_set(F.col("_now")) == as_set(F.col("ground_truth")), "members")

    pairs = edges.select("domain", F.col("src").alias("concept_id_a"), F.col("dst").alias("concept_id_b")).distinct()
    t5 = of("T5_cross_concept")
    t5_edge = t5.join(pairs, ["domain", "concept_id_a", "concept_id_b"], "left_anti").select("id", F.lit("edge").alias("reason"))
    ends = t5.join(named("concept_id_a", "_a"), ["domain", "concept_id_a"], "left").join(named("concept_id_b", "_b"), ["domain", "concept_id_b"], "left")
    t5_labels = wrong(ends, plain(F.array("_a", "_b")) == plain(F.slice("ground_truth", 1, 2)), "labels")
    out = t1
    for part in (t2, t3, t3_steps, t4, t5_edge, t5_labels):
        out = out.unionAll(part)
    return out


def leaked(rows: DataFrame, forbidden: Sequence[str] = ("ground_truth", "hop_depth", "concept_id", "path_ids", "concept_id_a", "concept_id_b")) -> DataFrame:
    """key, n: the keys among ``forbidden`` that documents (text, JSON objects as text) or columns hold; none should."""
    held = [c for c in forbidden if c in rows.columns]
    counts = [F.count(F.col(c)).alias(c) for c in held]
    if "document" in rows.columns:
        keys = F.json_object_keys("document")
        counts += [F.count_if(F.array_contains(keys, c)).alias(c) for c in forbidden if c not in held]
    found = rows.agg(*counts) if counts else rows.sparkSession.createDataFrame([(0,)], "_none long")
    names = [c for c in found.columns if c != "_none"]
    each = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in names]) if names else F.array().cast("array<struct<key:string,n:bigint>>")
    return found.select(F.explode(each).alias("x")).select("x.*").where("n > 0")
