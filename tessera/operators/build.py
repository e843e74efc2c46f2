"""From source records to a ranked, typed graph with provenance and questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as t
from tessera.storage import stored

TRIAL_SCHEMA = (
    "nct_id string, url string, title string, official_title string, brief_summary string, detailed_description string, eligibility_criteria string, conditions array<string>, "
    "interventions array<struct<name:string,type:string,description:string>>, primary_outcomes array<struct<measure:string,description:string>>, "
    "secondary_outcomes array<struct<measure:string,description:string>>, phases array<string>, status string, enrollment string, sponsor string, study_type string, search_terms array<string>, source_hash string"
)
# The names of what is read of a nested study payload.
PAYLOAD_SCHEMA = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,statusModule:struct<overallStatus:string>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,descriptionModule:struct<briefSummary:string,detailedDescription:string>,conditionsModule:struct<conditions:array<string>>,"
    "designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:string>>,armsInterventionsModule:struct<interventions:array<struct<name:string,type:string,description:string>>>,"
    "outcomesModule:struct<primaryOutcomes:array<struct<measure:string,description:string>>,secondaryOutcomes:array<struct<measure:string,description:string>>>,eligibilityModule:struct<eligibilityCriteria:string>>"
)
# Labels that name nothing; the ranked categories with their frame and their most nodes.
NO_LABEL = ("unknown", "not applicable", "na", "n/a")
RANKED = (("COND", "Condition landscape", 30), ("INTR", "Intervention landscape", 40), ("OUTC", "Endpoint landscape", 35), ("SPON", "Sponsor landscape", 25), ("PHASE", "Trial design landscape", 12), ("STATUS", "Recruitment and status landscape", 12))
MAX_CONCEPTS = 180


def extract_trials(payloads: DataFrame, search_term: Column, study_url: str = "") -> DataFrame:
    """Normalised records (TRIAL_SCHEMA) of raw study payloads (column ``payload``, JSON text).

    ``study_url``: what the address of a study begins with.  An outcome without
    a measure is named by its description; records without a name go.
    """
    p = F.from_json("payload", PAYLOAD_SCHEMA)["protocolSection"]
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def labels(c: Column, limit: int) -> Column:
        return F.filter(F.transform(F.coalesce(c, empty("string")), lambda x: t.clean_label(x, limit)), lambda x: x != "")

    def outcomes(c: Column) -> Column:
        kind = "struct<measure:string,description:string>"
        name = lambda x: t.clean_label(F.coalesce(F.nullif(x["measure"], F.lit("")), x["description"]), 140)
        each = F.transform(F.coalesce(c, empty(kind)), lambda x: F.struct(name(x).alias("measure"), t.clean_text(x["description"]).alias("description")))
        return F.filter(each, lambda x: x["measure"] != "")

    def interventions(c: Column) -> Column:
        kind = "struct<name:string,type:string,description:string>"
        parts = lambda x: [t.clean_label(x["name"], 120).alias("name"), t.clean_label(x["type"], 80).alias("type"), t.clean_text(x["description"]).alias("description")]
        return F.filter(F.transform(F.coalesce(c, empty(kind)), lambda x: F.struct(*parts(x))), lambda x: x["name"] != "")

    names, told, design, found = p["identificationModule"], p["descriptionModule"], p["designModule"], p["outcomesModule"]
    nct = t.clean_label(names["nctId"], 32)
    return payloads.select(
        nct.alias("nct_id"),
        F.concat(F.lit(study_url), nct).alias("url"),
        t.clean_text(names["briefTitle"]).alias("title"),
        t.clean_text(names["officialTitle"]).alias("official_title"),
        t.clean_text(told["briefSummary"]).alias("brief_summary"),
        t.clean_text(told["detailedDescription"]).alias("detailed_description"),
        t.clean_text(p["eligibilityModule"]["eligibilityCriteria"]).alias("eligibility_criteria"),
        labels(p["conditionsModule"]["conditions"], 120).alias("conditions"),
        interventions(p["armsInterventionsModule"]["interventions"]).alias("interventions"),
        outcomes(found["primaryOutcomes"]).alias("primary_outcomes"),
        outcomes(found["secondaryOutcomes"]).alias("secondary_outcomes"),
        labels(design["phases"], 60).alias("phases"),
        t.clean_label(p["statusModule"]["overallStatus"], 80).alias("status"),
        F.coalesce(design["enrollmentInfo"]["count"], F.lit("")).alias("enrollment"),
        t.clean_label(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"], 140).alias("sponsor"),
        t.clean_label(design["studyType"], 80).alias("study_type"),
        F.array(search_term).alias("search_terms"),
        F.sha2("payload", 256).alias("source_hash"),
    ).where("nct_id <> ''")


def first_trials(trials: DataFrame, most: int) -> DataFrame:
    """The first ``most`` trials by registry number; ``most`` is the feature, a build's size."""
    return trials.orderBy("nct_id").limit(most)


def merged(records: DataFrame, key: str, terms: str, order: str) -> DataFrame:
    """One row for each key: the first record, with all search terms in order of first sight."""
    rest = [c for c in records.columns if c not in (key, terms, order)]
    all_terms = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, terms))), lambda x: x[terms]))
    first = F.min_by(F.struct(*rest), order)
    return records.groupBy(key).agg(first.alias("_r"), F.array_distinct(all_terms).alias(terms)).select(key, *[F.col("_r")[c].alias(c) for c in rest], terms)


def ranked_labels(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """group, label, n, first, place: labels by frequency, ties by first sight.

    ``labels``: group columns, label, ord.  Labels that name nothing are left
    out.  Counting combines before the shuffle; only distinct labels are ranked.
    """
    return counted_labels(labels, group).withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*_by_frequency())))


def _by_frequency() -> tuple:
    return F.desc("n"), "first", "label"


def counted_labels(labels: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``ranked_labels`` without the places."""
    named = labels.where(F.col("label").isNotNull() & (F.col("label") != "") & ~F.lower("label").isin(*NO_LABEL))
    return named.groupBy(*group, "label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


#: What a mention tells of its trial.
TOLD = ("nct_id", "url", "source_hash")


def attribute_labels(trials: DataFrame, told: Sequence[str] = TOLD) -> DataFrame:
    """taxonomy_id, label, ord, nct_id, url, source_hash: every mention of an attribute.

    ``trials`` carries ``seq``, its file order; ``ord`` orders mentions, by
    trial and place in one number: the least of numbers is kept in place by a
    hash aggregation, the least of structs asks for a sort of all mentions.
    """
    outcome = lambda x: F.when(F.coalesce(x["measure"], F.lit("")) != "", x["measure"]).otherwise(t.first_sentence(x["description"]))
    phases = F.when(F.size(F.coalesce("phases", F.array().cast("array<string>"))) > 0, F.col("phases")).otherwise(F.array(F.lit("Not Applicable")))
    lists = {
        "COND": F.col("conditions"),
        "INTR": F.transform("interventions", lambda x: x["name"]),
        "OUTC": F.transform(F.concat("primary_outcomes", "secondary_outcomes"), outcome),
        "SPON": F.array("sponsor"),
        "PHASE": phases,
        "STATUS": F.array("status"),
    }
    tagged = F.flatten(F.array(*[_tagged(code, c) for code, c in lists.items()]))
    each = trials.select("seq", *told, F.posexplode(tagged).alias("pos", "x"))
    # a trial without a number comes before all others
    seq = F.coalesce(F.col("seq").cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    ord_ = (seq * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")
    return each.select(F.col("x.taxonomy_id").alias("taxonomy_id"), F.col("x.label").alias("label"), ord_.alias("ord"), *told).where("label <> ''")


def _tagged(code: str, c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(code).alias("taxonomy_id"), x.alias("label")))


def build_graph(spark: SparkSession, trials: DataFrame, domain: str, domain_label: str, max_concepts: int = MAX_CONCEPTS) -> DataFrame:
    """The node table (graph.NODE_SCHEMA) of one domain's trials.

    A root, its frames, the most frequent labels of each category up to its
    limit, each label once over all categories, then trials by how much they
    tell until ``max_concepts`` nodes.  Counting and ranking are distributed;
    the driver settles the labels, of which each category sends as many as the
    limits add up to, and ``max_concepts`` trials are numbered.
    """
    trials = stored(trials.select("seq", "nct_id", "title", "conditions", "interventions", "primary_outcomes", "secondary_outcomes", "phases", "status", "sponsor"), "trials")
    codes = {code: i for i, (code, _, _) in enumerate(RANKED)}
    frames = [f"{domain_label} clinical trial landscape", *[f for _, f, _ in RANKED]]
    # of labels that differ in case only the first counts; one beyond this place cannot get in, since the
    # labels skipped before it are those of frames and other categories
    most = sum(n for _, _, n in RANKED) + len(frames)
    counted = counted_labels(attribute_labels(trials, ()), ["taxonomy_id"]).withColumn("key", F.lower("label"))
    best_of = lambda rows, most, *group: rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*_by_frequency()))).where(F.col("place") <= most)
    # each task drops what lies beyond the limit before a category meets in one task
    first = best_of(best_of(counted, 1, "taxonomy_id", "key"), most, "taxonomy_id").collect()  # ``most`` rows a category
    fixed = [(1, t_clean(frames[0]), [], "AREA")] + [(i + 2, f, [1], "FRAME") for i, f in enumerate(frames[1:])]
    used, known, labelled, ids_of = {f.lower() for f in frames}, {}, [], []
    for code, _, n in RANKED:
        taken = 0
        for r in sorted((r for r in first if r["taxonomy_id"] == code), key=lambda r: r["place"]):
            if taken >= n or len(fixed) + len(labelled) >= max_concepts:
                break
            if r["key"] in used:
                continue
            used.add(r["key"])
            taken += 1
            label = t_clean(r["label"]) or "Unknown"
            if (code, label.lower()) not in known:  # labels that are equal once cleaned are one node
                known[code, label.lower()] = len(fixed) + len(labelled) + 1
                labelled.append((known[code, label.lower()], label, [codes[code] + 2], code))
            ids_of.append((code, r["label"], known[code, label.lower()]))
    left = max(0, max_concepts - len(fixed) - len(labelled))
    ids = spark.createDataFrame(ids_of or [("", "", 0)], "taxonomy_id string, label string, id long")  # at most the categories' limits
    richness = F.size("conditions") + F.size("interventions") + F.size("primary_outcomes")
    best = trials.withColumn("rich", richness).orderBy(F.desc("rich"), F.desc("nct_id")).limit(left)
    cap = lambda code, c: F.transform(c, lambda x: F.struct(F.lit(code).alias("taxonomy_id"), x.alias("label")))
    wanted = F.concat(cap("COND", F.slice("conditions", 1, 2)), cap("INTR", F.transform(F.slice("interventions", 1, 2), lambda x: x["name"])), cap("OUTC", F.transform(F.slice("primary_outcomes", 1, 1), lambda x: x["measure"])), cap("SPON", F.array("sponsor")), cap("PHASE", F.slice("phases", 1, 1)), cap("STATUS", F.array("status")))
    deps = best.select("nct_id", F.posexplode(wanted).alias("pos", "x")).select("nct_id", "pos", "x.*").join(F.broadcast(ids), ["taxonomy_id", "label"]).groupBy("nct_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])).alias("deps"))
    placed = F.row_number().over(Window.orderBy(F.desc("rich"), F.desc("nct_id"))) + len(fixed) + len(labelled)  # at most ``left`` rows
    trial = best.join(deps, "nct_id", "left").select(placed.cast("long").alias("id"), t.clean_label(F.concat_ws(" ", "nct_id", "title")).alias("label"), F.coalesce("deps", F.array(F.lit(1).cast("long"))).alias("dependencies"), F.lit("TRIAL").alias("taxonomy_id"))
    head = spark.createDataFrame(fixed + labelled, "id long, label string, dependencies array<long>, taxonomy_id string")
    return head.unionByName(trial).select(F.lit(domain).alias("domain"), "id", "label", "dependencies", "taxonomy_id", F.col("id").alias("ord"))


def t_clean(label: str, limit: int = 120) -> str:
    """The label rule of ``text.clean_label`` for the few labels the driver holds."""
    bare = " ".join(label.split())
    if bare[:1] in "*-" and bare[1:2] == " ":
        bare = bare[2:]
    bare = bare.strip(" .;:,")
    return bare if len(bare) <= limit else bare[: limit - 3].rstrip(" .;:,") + "..."


def provenance(trials: DataFrame, cap: int = 50) -> DataFrame:
    """taxonomy_id, key, sources: the first ``cap`` distinct (url, hash) of each label."""
    pairs = attribute_labels(trials).select("taxonomy_id", F.lower("label").alias("key"), "url", "source_hash")
    # by dense rank, so that each task drops what lies beyond the cap before anything is shuffled
    place = F.dense_rank().over(Window.partitionBy("taxonomy_id", "key").orderBy("url", "source_hash"))
    kept = pairs.withColumn("place", place).where(F.col("place") <= cap).select("taxonomy_id", "key", "url", "source_hash").distinct()
    return kept.groupBy("taxonomy_id", "key").agg(F.array_sort(F.collect_list(F.struct("url", "source_hash"))).alias("sources"))


def node_sources(nodes: DataFrame, trials: DataFrame, cap: int = 50) -> DataFrame:
    """domain, id, label, taxonomy_id, dependencies, sources of each node of a built graph.

    An attribute's sources are those of its label, a trial's its own; frames have none.
    """
    label = t.clean_label(F.concat_ws(" ", "nct_id", "title"))
    own = trials.select(F.lit("TRIAL").alias("taxonomy_id"), F.lower(label).alias("key"), F.array(F.struct("url", "source_hash")).alias("sources"))
    found = provenance(trials, cap).unionByName(own)
    out = nodes.withColumn("key", F.lower("label")).join(found, ["taxonomy_id", "key"], "left")
    told = F.filter(F.coalesce("sources", F.array().cast("array<struct<url:string,source_hash:string>>")), lambda x: (x["url"] != "") | (x["source_hash"] != ""))
    return out.select("domain", "id", "label", "taxonomy_id", "dependencies", told.alias("sources"))


def graph_summary(sources: DataFrame) -> DataFrame:
    """domain, taxonomy_id, nodes, edges, source_coverage of ``node_sources``; taxonomy_id null: the whole domain."""
    covered = F.avg((F.size("sources") > 0).cast("double"))
    sums = [F.count("*").alias("nodes"), F.sum(F.size("dependencies")).cast("long").alias("edges"), covered.alias("source_coverage")]
    return sources.groupingSets([("domain", "taxonomy_id"), ("domain",)], "domain", "taxonomy_id").agg(*sums)


def trial_markdown(trials: DataFrame) -> DataFrame:
    """nct_id, markdown: heading, address, terms, status line, conditions and, where a
    trial has them, interventions, outcomes (eight secondary ones) and long texts."""
    listed = lambda c: F.array_join(c, ", ")
    part = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}: "), body))
    said = lambda c: F.coalesce(c, F.lit(""))
    drug = lambda x: F.when(said(x["type"]) != "", F.concat(x["type"], F.lit(": "), x["name"])).otherwise(x["name"])
    measures = lambda c: F.array_join(F.transform(c, lambda x: x["measure"]), "; ")
    status = F.concat(F.lit("Status: "), said(F.col("status")), F.lit(" | Phase: "), listed("phases"), F.lit(" | Enrollment: "), said(F.col("enrollment")), F.lit(" | Sponsor: "), said(F.col("sponsor")))
    # step by step, as a text that is read in many places of one step is made anew in each
    long_texts = ("brief_summary", "detailed_description", "eligibility_criteria")
    trials = trials.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in long_texts})
    trials = trials.withColumns({c: t.squeeze_long(c) for c in long_texts})
    trials = trials.withColumns({c: t.cut(F.col(c)) for c in long_texts})
    parts = [
        F.concat(F.lit("## "), "nct_id", F.lit(": "), said(F.col("title"))),
        F.concat(F.lit("ClinicalTrials.gov: "), said(F.col("url"))),
        F.concat(F.lit("Matched search terms: "), listed("search_terms")),
        status,
        F.concat(F.lit("Conditions: "), listed("conditions")),
        part("Interventions", F.array_join(F.transform("interventions", drug), "; ")),
        part("Primary outcomes", measures(F.col("primary_outcomes"))),
        part("Secondary outcomes", measures(F.slice("secondary_outcomes", 1, 8))),
        part("Summary", F.col("brief_summary")),
        part("Detailed description", F.col("detailed_description")),
        part("Eligibility criteria", F.col("eligibility_criteria")),
    ]
    return trials.select("nct_id", F.concat_ws("\n\n", *parts).alias("markdown"))


def _pick(rows: DataFrame, group: Sequence[str], seed: str, n: int) -> DataFrame:
    """The first n rows of each group in an order that the seed decides."""
    order = Window.partitionBy(*group).orderBy(F.sha2(F.concat_ws(":", F.lit(seed), *group, "id"), 256), "id")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def balanced_sample(questions: DataFrame, per_type: int, seed: str) -> DataFrame:
    """``per_type`` questions for each domain and type; fewer is an error.

    Aggregate questions are taken in rotation instead: by id, from an offset
    that moves on with the domain, so that all domains together cover the categories.
    """
    sizes = questions.groupBy("domain", "type").count()
    short = F.when(F.col("count") < per_type, F.raise_error(F.concat(F.lit("too few questions of type "), "type")).cast("long")).otherwise(F.col("count"))
    domains = questions.select("domain").distinct().withColumn("_d", F.row_number().over(Window.orderBy("domain")) - 1)  # one row for each domain
    checked = questions.join(sizes.select("domain", "type", short.alias("_n")), ["domain", "type"]).where("_n > 0")
    turn = checked.where("type = 'T4_aggregate'").join(domains, "domain")
    place = F.row_number().over(Window.partitionBy("domain").orderBy("id")) - 1
    turned = turn.withColumn("_k", place).where(F.pmod(F.col("_k") - F.col("_d") * per_type, F.col("_n")) < per_type).drop("_k", "_d", "_n")
    return _pick(checked.where("type <> 'T4_aggregate'").drop("_n"), ["domain", "type"], seed, per_type).unionByName(turned)


def stratified_sample(questions: DataFrame, n: int, seed: str) -> DataFrame:
    """About n questions, each type in proportion (half to even, one at least)."""
    sizes = questions.groupBy("type").agg(F.count("*").alias("_m"))
    total = sizes.agg(F.sum("_m").alias("_all"))
    share = F.greatest(F.lit(1), F.bround(n * F.col("_m") / F.col("_all"))).cast("int")
    quota = sizes.crossJoin(total).select("type", share.alias("_q"))  # a row for each type
    order = Window.partitionBy("type").orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "type", "id"), 256), "id")
    picked = questions.join(F.broadcast(quota), "type").withColumn("_k", F.row_number().over(order)).where("_k <= _q")
    return picked.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), "id").limit(n).drop("_k", "_q")


def replay(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """The questions of a frozen id list (pos, id) in its order; an unknown id is an error."""
    found = ids.join(questions.withColumn("_known", F.lit(True)), "id", "left")
    checked = F.when(F.col("_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unknown question: "), F.col("id").cast("string"))).cast(questions.schema["id"].dataType))
    return found.withColumn("id", checked).drop("_known")
