"""Readers, writers and streams through temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.sources import files, sinks
from tessera.sources.paged import PagedSource
from tessera.streaming import rollup


def test_graph_files(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1/learning-graph.csv").write_text('ConceptID,ConceptLabel,Dependencies,TaxonomyID\n1,Root,,AREA\n2," A, ""b"" ",1|x| 3|,COND\n3,C,1,\n2,Again,1,INTR\n')
    got = {r["id"]: r for r in files.read_graphs(spark, f"{tmp_path}/*/learning-graph.csv").collect()}
    assert got[2]["label"] == "Again" and got[2]["dependencies"] == [1] and got[2]["domain"] == "d1"
    assert got[3]["taxonomy_id"] == "" and [i for i, _ in sorted(got.items(), key=lambda x: x[1]["ord"])] == [1, 2, 3]
    lists = spark.createDataFrame([("1|x| 3|",)], "c string")
    assert lists.select(files.dependency_list(F.col("c"))).first()[0] == [1, 3]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        lists.select(files.dependency_list(F.col("c"), strict=True)).collect()


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1, "x, y", [], "AREA", 1), ("a", 2, 'q"t"', [1, 1], "COND", 2), ("b", 1, "z", [], "AREA", 1)], g.NODE_SCHEMA)
    sinks.write_graph(nodes, f"{tmp_path}/g")
    back = files.read_graphs(spark, f"{tmp_path}/g/*/learning-graph.csv")
    assert {(r["domain"], r["id"], r["label"], tuple(r["dependencies"]), r["taxonomy_id"]) for r in back.collect()} == {("a", 1, "x, y", (), "AREA"), ("a", 2, 'q"t"', (1,), "COND"), ("b", 1, "z", (), "AREA")}
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == ["a", "b"]


def test_rows(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id": "1", "query_type": "T1_entity"}\n\n{"id": "2", "type": "T2_dependency"}\n')
    assert {(r["id"], r["type"]) for r in files.read_questions(spark, str(p)).collect()} == {("1", "T1_entity"), ("2", "T2_dependency")}
    p.write_text('{"id": "1"}\n{broken\n')
    assert [r["file"] for r in files.read_rows(spark, str(p), "id string", tolerant=True).collect()] == ["r.jsonl"]
    with pytest.raises(Exception, match="MALFORMED|BAD"):
        files.read_rows(spark, str(p), "id string").collect()
    rows = spark.createDataFrame([("s", "d", "T1", 1), ("s", "e", "T2", 0)], "system string, domain string, type string, total_tokens int")
    sinks.write_rows(rows, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists"):
        sinks.write_rows(rows, f"{tmp_path}/out")
    sinks.write_rows(rows.where("domain = 'd'").withColumn("total_tokens", F.lit(9)), f"{tmp_path}/out", replace=True)
    assert sorted(r["total_tokens"] for r in spark.read.json(f"{tmp_path}/out").collect()) == [0, 9]
    merged = sinks.merge_rows(rows, rows.where("type = 'T1'").withColumn("total_tokens", F.lit(5)))
    assert sorted((r["type"], r["total_tokens"]) for r in merged.collect()) == [("T1", 5), ("T2", 0)]
    assert sinks.finished(rows) and not sinks.finished(rows.where("type = 'T2'"))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "a"}, {"id": "b"}], indent=1))
    manifest = files.read_document(spark, f"{tmp_path}/m.json", "id string")
    assert files.select_domains(manifest).count() == 2 and files.select_domains(manifest, ["b"]).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        files.select_domains(manifest, ["z"])
    with pytest.raises(ValueError, match="repeated"):
        files.select_domains(manifest.unionAll(manifest))


def test_markdown_and_hashes(spark, tmp_path):
    docs = tmp_path / "area-x/docs/chapters/01"
    docs.mkdir(parents=True)
    (docs / "index.md").write_text("age <26 years\n" + "w\n" * 200 + "<!-- gone -->")
    (docs.parents[1] / "glossary.md").write_text("short")
    got = files.read_markdown(spark, str(tmp_path)).collect()
    assert [(r["domain"], r["source"]) for r in got] == [("area-x", "chapters/01/index.md")] and "<26" in got[0]["text"] and "gone" not in got[0]["text"]
    assert files.read_hashes(spark, str(tmp_path), tmp_path.name).count() == 2


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    pages = {"x/": {"studies": [{"n": 1}, {"n": 2}], "nextPageToken": "t"}, "x/t": {"studies": [{"n": 3}], "nextPageToken": "u"}, "y/": {"studies": []}}
    df = spark.read.format("paged_json").option("terms", '["x", "y"]').option("pageSize", "2").option("pages", json.dumps(pages)).load()
    assert sorted((r["search_term"], r["seq"], r["payload"]) for r in df.collect()) == [("x", 0, '{"n": 1}'), ("x", 1, '{"n": 2}'), ("x", 2, '{"n": 3}')]


def test_streams(spark, tmp_path):
    schema = "ts timestamp, system string, type string, f1 double, total_tokens long"
    (tmp_path / "in").mkdir()
    lines = [{"ts": f"2024-01-01T00:0{m}:00Z", "system": "s", "type": "T1", "f1": m / 10, "total_tokens": m} for m in (1, 2, 7)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    stream = rollup.windowed_scores(rollup.read_result_stream(spark, f"{tmp_path}/in", schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("scores").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["n"], r["tokens"]) for r in spark.table("scores").collect()) == [(1, 7), (2, 3)]


def test_documents_and_chapters(spark, tmp_path):
    sinks.write_document(spark, {"b": 1, "a": [2]}, f"{tmp_path}/doc")
    assert files.read_document(spark, f"{tmp_path}/doc", "a array<int>, b int").first().asDict() == {"a": [2], "b": 1}
    payload = {"protocolSection": {
        "identificationModule": {"nctId": "NCT00000007", "briefTitle": "T", "officialTitle": "Long T"}, "descriptionModule": {"briefSummary": "s " * 150, "detailedDescription": "d."},
        "armsInterventionsModule": {"interventions": [{"name": "- n.", "type": "DRUG"}]}, "outcomesModule": {"primaryOutcomes": [{"description": "described only"}, {"timeFrame": "1"}]},
        "designModule": {"phases": ["PHASE2"], "enrollmentInfo": {"count": 7}}, "eligibilityModule": {"eligibilityCriteria": "Adults"},
    }}
    raw = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    from tessera.operators import build

    trials = build.extract_trials(raw, F.lit("a term"), "u/")
    one = trials.first()
    assert (one["url"], one["official_title"], one["detailed_description"], one["enrollment"]) == ("u/NCT00000007", "Long T", "d.", "7")
    assert [x["measure"] for x in one["primary_outcomes"]] == ["described only"] and [tuple(x) for x in one["interventions"]] == [("n", "DRUG", "")]
    domain = {"id": "area-y", "label": "Y", "rationale": "r", "queries": [{"field": "cond", "term": "A term"}, {"field": "cond", "term": "a term"}]}
    assert sinks.write_chapters(trials, domain, f"{tmp_path}/md") == 2
    got = {r["source"]: r["text"] for r in files.read_markdown(spark, f"{tmp_path}/md", least=0).collect()}
    assert sorted(got) == ["chapters/01-a-term/index.md", "chapters/02-a-term/index.md", "course-description.md"]
    assert got["chapters/01-a-term/index.md"] == "# Y: A term\n\nSource: ClinicalTrials.gov API v2, cond=A term\nTrial count in this chapter: 0"
    assert got["chapters/02-a-term/index.md"].startswith("# Y: a term\n\nSource: ClinicalTrials.gov API v2, cond=a term\nTrial count in this chapter: 1\n\n## NCT00000007: T\n\nClinicalTrials.gov: u/NCT00000007\n\nMatched search terms: a term\n\nStatus:  | Phase: PHASE2 | Enrollment: 7 | Sponsor: ")
    assert got["course-description.md"].endswith("Search terms:\n- cond=A term\n- cond=a term")
