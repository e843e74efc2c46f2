"""Graph, retrieval, build, roll-up and integrity operators on small inputs."""

import json
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tessera.operators import build as b
from tessera.operators import graph as g
from tessera.operators import integrity, questions, retrieval, rollup

NODES = [(1, "Root", [], "AREA"), (2, "Left", [1], "FRAME"), (3, "Right", [1], "FRAME"), (4, "Deep left", [2, 3], "COND"), (5, "Leaf", [4, 2], "INTR"), (6, "Alone", [], "GEN")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("d", i, x, d, c, i) for i, x, d, c in NODES], g.NODE_SCHEMA)


@pytest.fixture(scope="module")
def edges(nodes):
    return g.edges_of(nodes)


def pairs(spark, *ps):
    return spark.createDataFrame([("d", a, c) for a, c in ps], "domain string, start long, end long")


def test_breadth_first_order(spark, nodes, edges):
    got = {r["node"]: r for r in g.walk(spark.createDataFrame([("d", 5)], "domain string, start long"), edges).collect()}
    order = sorted(got.values(), key=lambda r: (r["depth"], r["key"]))
    assert [r["node"] for r in order] == [5, 4, 2, 3, 1]
    assert got[1]["path"] == [5, 2, 1]


def test_paths(spark, nodes, edges):
    got = {(r["start"], r["end"]): r["path"] for r in g.undirected_paths(pairs(spark, (2, 3), (5, 5), (6, 1), (3, 5)), edges, nodes).collect()}
    assert got == {(2, 3): [2, 1, 3], (5, 5): [5], (6, 1): [6, 1], (3, 5): [3, 4, 5]}
    one = {(r["start"], r["end"]): r["path"] for r in g.directed_paths(pairs(spark, (5, 3), (1, 5)), edges, nodes).collect()}
    assert one == {(5, 3): [5, 4, 3], (1, 5): None}


def test_long_chains_and_cycles_end(spark):
    chain = spark.createDataFrame([("d", i, i + 1, 0) for i in range(36)] + [("d", 36, 30, 0)], "domain string, src long, dst long, pos long")
    got = {r["node"]: r["depth"] for r in g.walk(spark.createDataFrame([("d", 0)], "domain string, start long"), chain).collect()}
    assert got == {i: i for i in range(37)}


def test_absent_nodes_and_repeated_dependencies(spark):
    rows = [("d", 1, "One", [99, 3], "X", 1), ("d", 2, "Two", [99], "X", 2), ("d", 3, "Three", [], "X", 3), ("d", 4, "Four", [3, 3, 99], "X", 4), ("d", 5, "Five", [3], "X", 5)]
    flawed = spark.createDataFrame(rows, g.NODE_SCHEMA)
    edges = g.edges_of(flawed)
    assert [r["path"] for r in g.undirected_paths(pairs(spark, (1, 2)), edges, flawed).collect()] == [[1, 2]]
    first = {(r["id"], r["place"]): r["dependent"] for r in g.dependents(flawed, edges, 2).collect()}
    assert first == {(3, 1): 1, (3, 2): 4}
    up = g.ancestors(spark.createDataFrame([("d", 1)], "domain string, start long"), edges, flawed).collect()
    assert sorted(r["node"] for r in up) == [1, 3]
    with pytest.raises(Exception, match="missing node 99"):
        g.node_documents(flawed, edges).collect()


def test_resolution_tiers(spark, nodes):
    texts = spark.createDataFrame([("d", 1, "LEFT"), ("d", 2, "igh"), ("d", 3, "about the leaf now"), ("d", 4, "nothing"), ("d", 5, ""), ("d", 6, None), ("d", 7, "oo"), ("e", 8, "Left")], "domain string, key long, text string")
    got = {r["key"]: (r["node"], r["tier"]) for r in g.resolve(texts, nodes).collect()}
    assert got == {1: (2, 0), 2: (3, 1), 3: (5, 2), 7: (1, 1)}


def test_neighbourhoods(spark, nodes, edges):
    got = defaultdict(list)
    for r in g.neighbourhood(nodes, edges, cap=1).orderBy("id", "branch", "place").collect():
        got[r["id"]].append(r["member"])
    assert got[2] == [2, 1, 4] and got[4] == [4, 2, 3, 5] and got[6] == [6]
    ab = spark.createDataFrame([("d", 5, 4)], "domain string, a long, b long")
    t5 = [r["member"] for r in g.path_neighbourhood(ab, edges, nodes).orderBy("branch", "place").collect()]
    assert t5 == [5, 4, 2, 3]
    assert [r["common"] for r in g.shared(edges, spark.createDataFrame([("d", 2, 3)], "domain string, a long, b long"), False).collect()] == [4]


def test_dangling_and_degrees(spark, nodes, edges):
    assert g.dangling(edges.unionAll(spark.createDataFrame([("d", 1, 99, 0)], edges.schema)), nodes).count() == 1
    got = {r["id"]: (r["out_degree"], r["in_degree"], r["is_root"], r["is_leaf"]) for r in g.degrees(nodes, edges).collect()}
    assert got[5] == (2, 0, False, True) and got[1] == (0, 2, True, False) and got[6] == (0, 0, True, True)


def test_documents(spark, nodes, edges):
    docs = {r["document_id"]: r for r in g.node_documents(nodes, edges).collect()}
    assert docs["d:node:4"]["text"].split("\n") == [
        "Document kind: graph node", "Domain: d", "Node label: Deep left", "Node type: COND",
        "Direct prerequisites (outgoing depends_on targets): Left [FRAME]; Right [FRAME]", "Direct dependents (incoming depends_on sources): Leaf [INTR]",
    ]
    assert docs["d:node:6"]["text"].endswith("targets): none\nDirect dependents (incoming depends_on sources): none")
    assert g.edge_documents(nodes, edges).count() == 6
    named = spark.createDataFrame([("d", 1, "NCT00000002 b", [], "TRIAL", 1), ("d", 2, "nct00000001 a", [1], "COND", 2)], g.NODE_SCHEMA)
    node = g.node_documents(named, g.edges_of(named)).orderBy("node_id").first()
    assert node["nct_ids"] == ["NCT00000001", "NCT00000002"] and node["taxonomy_ids"] == ["TRIAL"]
    edge = g.edge_documents(named, g.edges_of(named)).first()
    assert (edge["document_id"], edge["label"], edge["taxonomy_ids"]) == ("d:edge:2:1", "nct00000001 a depends_on NCT00000002 b", ["COND", "TRIAL"])
    assert edge["text"].endswith("NCT/source identifiers present on this edge: NCT00000001, NCT00000002")


def test_windows_hold_the_text(spark):
    import public_tokenizers

    text = "L'Île d'été,\n  2.5 mg  " + "mot " * 30
    docs = spark.createDataFrame([("s", text)], "source string, text string")
    assert retrieval.windows(docs).first()["text"] == text.rstrip()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        ranks = f.read()
    got = retrieval.bpe_windows(docs, ranks, public_tokenizers.PATTERN, size=30, overlap=5, least=3).orderBy("start_token").collect()
    assert got[0]["text"] == text[: len(got[0]["text"])] and got[0]["n_tokens"] == 30 and [r["start_token"] for r in got] == [25 * i for i in range(len(got))]
    assert text.endswith(got[-1]["text"]) and got[-1]["start_token"] + 30 >= got[-1]["start_token"] + got[-1]["n_tokens"] > 3


@pytest.mark.parametrize(("n", "expected"), [(19, []), (20, [0]), (512, [0]), (513, [0, 462]), (974, [0, 462]), (975, [0, 462, 924])])
def test_windows(spark, n, expected):
    docs = spark.createDataFrame([("s", " ".join(f"t{i}" for i in range(n)))], "source string, text string")
    got = retrieval.windows(docs).orderBy("start_token").collect()
    assert [r["start_token"] for r in got] == expected


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta")], "doc long, text string")
    asked = spark.createDataFrame([(9, "alpha")], "query long, text string")
    scores = retrieval.with_silent(retrieval.bm25(asked, docs), asked, docs, 40)
    ranked = retrieval.top(scores, 40).orderBy("rank").collect()
    assert [r["doc"] for r in ranked] == [0, 1] and ranked[0]["score"] > ranked[1]["score"] == 0
    lists = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 1), (1, 2, 2)], "query long, doc long, rank int")
    assert [r["doc"] for r in retrieval.fuse(lists, 3, k=1).orderBy("rank").collect()] == [1, 0, 2]


def test_registry_filter(spark):
    asked = spark.createDataFrame([(1, "What is NCT01234567?"), (2, "plain"), (3, "NCT55555555")], "query long, text string")
    docs = spark.createDataFrame([(0, ["NCT99999999"]), (1, ["NCT01234567"])], "doc long, ids array<string>")
    scores = asked.select("query").crossJoin(docs.select("doc")).withColumn("score", F.lit(1.0))
    got = Counter((r["query"], r["doc"], r["filter"]) for r in retrieval.eligible(asked, docs, scores).collect())
    assert got == Counter([(1, 1, "domain+id"), (2, 0, "domain"), (2, 1, "domain"), (3, 0, "domain"), (3, 1, "domain")])


def test_questions_are_grounded(nodes, edges):
    asked = questions.generate(nodes, edges)
    assert integrity.ungrounded(asked, nodes, edges).count() == 0
    t3 = {r["id"]: r for r in asked.where("type = 'T3_path'").collect()}
    assert t3["d_T3_1_5"]["path_ids"] == [5, 2, 1] and t3["d_T3_1_5"]["query"] == "What is the prerequisite chain from Root to Leaf?"
    seen = {r["type"]: (r["first"], r["second"]) for r in questions.parsed(asked.where("id in ('d_T1_5', 'd_T2_4', 'd_T3_1_5', 'd_T4_FRAME', 'd_T5_5_4')")).collect()}
    assert seen == {"T1_entity": ("Leaf", ""), "T2_dependency": ("Deep left", ""), "T3_path": ("Root", "Leaf"), "T4_aggregate": ("FRAME", ""), "T5_cross_concept": ("Leaf", "Deep left")}


def test_comparisons(spark):
    side = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "id long, value double")
    assert tuple(rollup.win_loss_tie(side(1.0, 0.0, 0.5), side(0.0, 1.0, 0.5)).first()) == (1, 1, 1, 3)
    with pytest.raises(Exception, match="one side only"):
        rollup.win_loss_tie(side(1.0, 0.0), side(1.0)).collect()
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "id long, v double, s string")
    c = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, 2.1, None), (4, 3.0, "z")], "id long, v double, s string")
    got = {(r["id"], r["field"]) for r in integrity.differing(a, c, ["id"], ["s"], {"v": 1e-9}).collect()}
    assert got == {(2, "v"), (3, "row"), (4, "row")}


def test_samples(spark):
    rows = [(f"{d}-{k}-{i}", d, k) for d in "abc" for k in ("T1", "T4_aggregate") for i in range(9)]
    df = spark.createDataFrame(rows, "id string, domain string, type string")
    got = b.balanced_sample(df, 4, "s").collect()
    assert Counter((r["domain"], r["type"]) for r in got) == Counter({(d, k): 4 for d in "abc" for k in ("T1", "T4_aggregate")})
    assert len({r["id"][2:] for r in got if r["type"] == "T4_aggregate"}) == 9
    assert sorted(r["id"] for r in b.balanced_sample(df, 4, "s").collect()) == sorted(r["id"] for r in got)
    with pytest.raises(Exception, match="too few"):
        b.balanced_sample(df, 10, "s").collect()
    with pytest.raises(Exception, match="unknown question"):
        b.replay(df, spark.createDataFrame([(0, "zz")], "pos int, id string")).collect()


def _plain_graph(trials, label, most=b.MAX_CONCEPTS):
    frames = [f"{label} clinical trial landscape", *[f for _, f, _ in b.RANKED]]
    nodes = [(1, frames[0], [], "AREA")] + [(i + 2, f, [1], "FRAME") for i, f in enumerate(frames[1:])]
    used, ids = {f.lower() for f in frames}, {}
    for c, (code, _, limit) in enumerate(b.RANKED):
        names = []
        for t in trials:
            names += {"COND": t["conditions"], "INTR": [x["name"] for x in t["interventions"]], "OUTC": [x["measure"] for x in t["primary_outcomes"] + t["secondary_outcomes"]], "SPON": [t["sponsor"]], "PHASE": t["phases"] or ["Not Applicable"], "STATUS": [t["status"]]}[code]
        n = 0
        for name, _ in Counter(x for x in names if x).most_common():
            if n >= limit or len(nodes) >= most:
                break
            if name.lower() in used or name.lower() in b.NO_LABEL:
                continue
            used.add(name.lower())
            ids[code, name] = len(nodes) + 1
            nodes.append((len(nodes) + 1, name, [c + 2], code))
            n += 1
    for t in sorted(trials, key=lambda t: (len(t["conditions"]) + len(t["interventions"]) + len(t["primary_outcomes"]), t["nct_id"]), reverse=True):
        if len(nodes) >= most:
            break
        wanted = [("COND", x) for x in t["conditions"][:2]] + [("INTR", x["name"]) for x in t["interventions"][:2]] + [("OUTC", x["measure"]) for x in t["primary_outcomes"][:1]] + [("SPON", t["sponsor"])] + [("PHASE", x) for x in t["phases"][:1]] + [("STATUS", t["status"])]
        deps = list(dict.fromkeys(ids[w] for w in wanted if w in ids)) or [1]
        nodes.append((len(nodes) + 1, f"{t['nct_id']} {t['title']}", deps, "TRIAL"))
    return nodes


def test_equal_clean_labels_are_one_node(spark):
    schema = ", ".join(["seq long", *[c for c in b.TRIAL_SCHEMA.split(", ") if c.split(" ")[0] in ("nct_id", "url", "title", "conditions", "phases", "status", "sponsor", "source_hash")], "interventions array<struct<name:string,type:string,description:string>>", "primary_outcomes array<struct<measure:string,description:string>>", "secondary_outcomes array<struct<measure:string,description:string>>"])
    trial = lambda i, c: (i, f"N{i}", f"u{i}", "T", c, [], "S", "Sp", f"h{i}", [], [], [])
    trials = spark.createDataFrame([trial(1, ["Pain", "Pain."]), trial(2, ["Pain."])], schema)
    nodes = b.build_graph(spark, trials, "d", "D").cache()
    assert [r["label"] for r in nodes.where("taxonomy_id = 'COND'").collect()] == ["Pain"]
    pain = nodes.where("taxonomy_id = 'COND'").first()["id"]
    assert all(r["dependencies"][0] == pain for r in nodes.where("taxonomy_id = 'TRIAL'").collect())
    sources = {r["label"]: [s["url"] for s in r["sources"]] for r in b.node_sources(nodes, trials).collect()}
    assert sources["Pain"] == ["u1"] and sources["N2 T"] == ["u2"] and sources["Condition landscape"] == [] and sources["S"] == ["u1", "u2"]
    whole = b.graph_summary(b.node_sources(nodes, trials)).where("taxonomy_id is null").first()
    assert whole["nodes"] == nodes.count() and 0 < whole["source_coverage"] < 1


@pytest.mark.parametrize("most", [b.MAX_CONCEPTS, 20])
def test_built_graph(spark, most):
    from tessera.plans.build_queries import order_trials

    trials = order_trials(spark, "/root/testdata/sf0.001").limit(300).cache()
    got = b.build_graph(spark, trials, "d", "Trade", most).orderBy("id").collect()
    rows = [r.asDict(recursive=True) for r in trials.orderBy("seq").collect()]
    assert [(r["id"], r["label"], r["dependencies"], r["taxonomy_id"]) for r in got] == _plain_graph(rows, "Trade", most)


def test_trials_from_payloads(spark):
    study = {"protocolSection": {"identificationModule": {"nctId": " NCT00000001 ", "briefTitle": "A  b"}, "conditionsModule": {"conditions": ["x", "", " y "]}, "armsInterventionsModule": {"interventions": [{"name": "n", "type": "DRUG"}, {"type": "DRUG"}]}, "designModule": {"enrollmentInfo": {"count": 7}}, "outcomesModule": {"primaryOutcomes": [{"measure": "m"}, {}]}}}
    raw = spark.createDataFrame([(json.dumps(study), "t1", 0), ("{}", "t1", 1), (json.dumps(study), "t2", 2)], "payload string, term string, seq int")
    one = b.extract_trials(raw, F.col("term")).withColumn("seq", F.monotonically_increasing_id())
    got = b.merged(one, "nct_id", "search_terms", "seq").collect()
    assert len(got) == 1
    r = got[0]
    assert (r["nct_id"], r["title"], r["conditions"], r["enrollment"], r["search_terms"]) == ("NCT00000001", "A b", ["x", "y"], "7", ["t1", "t2"])
    assert [x["name"] for x in r["interventions"]] == ["n"] and [x["measure"] for x in r["primary_outcomes"]] == ["m"]


def test_walk_agrees_with_a_queue(spark):
    import random

    rng = random.Random(8)
    deps = {i: rng.sample(range(i), min(i, rng.randint(0, 3))) for i in range(60)}
    df = spark.createDataFrame([("d", i, str(i), d, "X", i) for i, d in deps.items()], g.NODE_SCHEMA)
    got = defaultdict(list)
    for r in g.walk(df.select("domain", F.col("id").alias("start")), g.edges_of(df)).orderBy("start", "depth", "key").collect():
        got[r["start"]].append((r["node"], tuple(r["path"])))
    for s in deps:
        seen, queue, order = {s: (s,)}, deque([s]), []
        while queue:
            x = queue.popleft()
            order.append((x, seen[x]))
            for d in deps[x]:
                if d not in seen:
                    seen[d] = (*seen[x], d)
                    queue.append(d)
        assert got[s] == order


def test_contexts_of_all_types(spark, nodes, edges):
    from tessera.operators import answering

    rows = [("1", "T1_entity", "What is Left?"), ("2", "T2_dependency", "prerequisites for deep left"), ("3", "T3_path", "prerequisite chain from Root to Leaf?"), ("3b", "T3_path", "prerequisite chain from zzz to Deep left?"), ("4", "T4_aggregate", "List all fram concepts"), ("4b", "T4_aggregate", "List all nope concepts"), ("5", "T5_cross_concept", "How does Leaf relate to Deep left?"), ("6", "T2_dependency", "prerequisites for nobody"), ("7", "T8", "?")]
    asked = spark.createDataFrame([(i, "d", k, q) for i, k, q in rows], "id string, domain string, type string, query string")
    ids = {}
    for r in answering.retrieved(asked, nodes, edges).orderBy("id", "branch", "place").collect():
        ids.setdefault(r["id"], []).append(r["member"])
    assert ids == {"1": [2, 1, 4, 5], "2": [4, 2, 3], "3": [1, 2, 5], "3b": [4, 2, 3, 1], "4": [2, 3], "5": [5, 4, 2, 3]}
    told = {r["id"]: r["context"] for r in answering.contexts(asked, nodes, edges).collect()}
    assert told["4b"] == answering.HEADER and told["6"] == answering.NOTHING and told["7"] == answering.NO_TYPE
    assert told["2"].split("\n")[1:] == ["  [COND] Deep left | prerequisites: Left, Right", "  [FRAME] Left | prerequisites: Root", "  [FRAME] Right | prerequisites: Root"]


def test_annotations_name_the_nodes(spark, nodes, edges):
    from tessera.operators import answering

    blank = dict.fromkeys(("ground_truth", "concept_id", "path_ids", "taxonomy_id", "concept_id_a", "concept_id_b"))
    rows = [
        ("1", "T1_entity", {"concept_id": 2}), ("1b", "T1_entity", {"ground_truth": ["left"]}), ("2", "T2_dependency", {}), ("3", "T3_path", {"path_ids": [5, 2, 1]}),
        ("3b", "T3_path", {"ground_truth": ["Leaf", "zzz", "Root"]}), ("3c", "T3_path", {"ground_truth": ["zzz"], "concept_id": 4, "path_ids": []}), ("4", "T4_aggregate", {"taxonomy_id": "FRAME"}),
        ("4b", "T4_aggregate", {"taxonomy_id": "", "ground_truth": ["Right", "Left"]}), ("4c", "T4_aggregate", {"taxonomy_id": "fram"}), ("5", "T5_cross_concept", {"concept_id_a": 5, "concept_id_b": 4}),
        ("5b", "T5_cross_concept", {"concept_id_a": 5, "concept_id_b": 77}), ("6", "T1_entity", {"concept_id": 77, "ground_truth": ["nobody"]}), ("7", "T8", {}),
    ]
    kinds = "id string, domain string, type string, query string, ground_truth array<string>, concept_id long, path_ids array<long>, taxonomy_id string, concept_id_a long, concept_id_b long"
    asked = spark.createDataFrame([{"id": i, "domain": "d", "type": k, "query": "What are the prerequisites for Deep left?", **blank, **more} for i, k, more in rows], kinds)
    ids = {}
    for r in answering.annotated(asked, nodes, edges).orderBy("id", "branch", "place").collect():
        ids.setdefault(r["id"], []).append(r["member"])
    assert ids == {"1": [2, 1, 4, 5], "1b": [2, 1, 4, 5], "2": [4, 2, 3], "3": [5, 2, 1], "3b": [5, 1], "3c": [4, 2, 3, 1], "4": [2, 3], "4b": [3, 2], "5": [5, 4, 2, 3]}
    told = {r["id"]: r["context"] for r in answering.contexts(asked, nodes, edges, by_annotation=True).collect()}
    assert told["4c"] == told["5b"] == answering.HEADER and told["6"] == answering.NOTHING and told["7"] == answering.NO_TYPE


def test_a_failing_model_is_asked_again(spark, tmp_path):
    import pandas as pd

    from tessera.operators import answering

    def model(prompts):
        tries = tmp_path / "tries"
        tries.write_text((tries.read_text() if tries.exists() else "") + "x")
        if len(tries.read_text()) < 3:
            raise ConnectionError
        return pd.Series(["yes"] * len(prompts))

    rows = spark.createDataFrame([("1", "p")], "id string, prompt string").coalesce(1)
    assert [r["answer"] for r in answering.answers(rows, model, pause=0.0).collect()] == ["yes"]


def test_answers_are_scored(spark):
    import pandas as pd

    from tessera.operators import answering

    rows = spark.createDataFrame([("1", "T2_dependency", ["Left"], "Left is here", "p1"), ("2", "T1_entity", ["X", "INTR"], "an intervention", "p2")], "id string, type string, ground_truth array<string>, context string, prompt string")
    rows = rows.withColumns({"prompt_tokens": F.lit(100), "completion_tokens": F.lit(10)})
    model = lambda p: pd.Series(['{"labels": ["left"]}' if x == "p1" else 'so {"labels": ["treatment", "x"]}' for x in p])
    got = {r["id"]: r for r in answering.evaluated(answering.answers(rows, model)).collect()}
    assert (got["1"]["f1"], got["1"]["exact"], got["1"]["strict"], got["1"]["coverage"], got["1"]["cost"]) == (1.0, True, True, 1.0, 0.00015)
    assert (got["2"]["f1"], got["2"]["strict"], got["2"]["extractable"], got["2"]["coverage"]) == (0.666667, False, True, 1.0)
    old = {r["id"]: r["f1"] for r in answering.evaluated(answering.answers(rows, model), older=True).collect()}
    assert old["2"] == 1.0
    assert {r["f1"] for r in answering.evaluated(answering.answers(rows)).collect()} == {0.0}


def test_tools(nodes, edges):
    from tessera.plans import tools

    assert tools.list_domains(nodes, edges).first()["edges"] == 6
    assert [r["id"] for r in tools.search_concepts(nodes, "LEFT", "cond", "d").collect()] == [4]
    assert [(r["direction"], r["label"]) for r in tools.get_relationship_context(nodes, edges, "d", "left").collect()] == [("depends on", "Root"), ("needed by", "Deep left"), ("needed by", "Leaf")]
    assert tools.explain_scope_and_limitations(nodes, edges).count() == 5
