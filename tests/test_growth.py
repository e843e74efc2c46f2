"""Work that grows with the input alone: rows stored on the way, and results against plain Python."""

import random
from collections import deque

import pytest

from tessera import storage
from tessera.operators import graph as g

D = "d"


@pytest.fixture
def rows_stored(monkeypatch):
    """Rows of the tables stored by graph operators, by label."""
    sizes: dict[str, int] = {}

    def counted(df, label, level=3, keep=storage.stored):
        out = keep(df, label, level)
        sizes[label] = sizes.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(storage, "stored", counted)
    monkeypatch.setattr(g, "stored", counted)
    return sizes


def graph(spark, deps):
    nodes = spark.createDataFrame([(D, i, f"n{i}", d, "T", i) for i, d in deps.items()], g.NODE_SCHEMA)
    return nodes, g.edges_of(nodes)


def pairs_of(spark, pairs):
    return spark.createDataFrame([(D, a, b) for a, b in pairs], "domain string, start long, end long")


def plain(start, end, steps):
    """The shortest path with the smallest hops; ``steps``: node to hops in order."""
    seen, queue = {start: [start]}, deque([start])
    while queue:
        at = queue.popleft()
        for n in steps.get(at, []):
            if n not in seen:
                seen[n] = seen[at] + [n]
                queue.append(n)
    return seen.get(end)


def random_deps(seed, n=24):
    r = random.Random(seed)
    return {i: [r.randrange(n + 2) for _ in range(r.choice([0, 1, 1, 2]))] for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_are_the_plain_ones(spark, seed):
    deps = random_deps(seed)
    nodes, edges = graph(spark, deps)
    there = {i: [d for d in ds if d in deps] for i, ds in deps.items()}
    both = {i: sorted({*there[i], *(j for j in deps if i in there[j])}) for i in deps}
    asked = [(a, b) for a in deps for b in deps if (a * 7 + b) % 3 == 0] + [(99, 99), (99, 1)]
    found = {(r["start"], r["end"]): r["path"] for r in g.undirected_paths(pairs_of(spark, asked), edges, nodes).collect()}
    assert found == {(a, b): plain(a, b, both) or [a, b] for a, b in asked}
    to_few = [(a, b) for a in deps for b in (0, 1, 5)]
    found = {(r["start"], r["end"]): r["path"] for r in g.directed_paths(pairs_of(spark, to_few), edges, nodes).collect()}
    assert found == {(a, b): plain(a, b, there) for a, b in to_few}


def test_the_leaves_of_a_hub_are_not_walked_from_each_other(spark, rows_stored):
    """120 leaves of one hub gave 120 * 119 rows of a level."""
    nodes, edges = graph(spark, {0: []} | {i: [0] for i in range(1, 121)})
    out = g.undirected_paths(pairs_of(spark, [(i, i + 1) for i in range(1, 120)]), edges, nodes)
    assert {tuple(r["path"]) for r in out.collect()} == {(i, 0, i + 1) for i in range(1, 120)}
    assert rows_stored["walk"] <= 10


def test_paths_to_one_root_are_searched_from_the_root(spark, rows_stored):
    """each of 100 nodes below a chain of 6 walked the chain for itself, 700 rows."""
    deps = {0: []} | {i: [i - 1] for i in range(1, 6)} | {i: [5] for i in range(10, 110)}
    nodes, edges = graph(spark, deps)
    out = g.directed_paths(pairs_of(spark, [(i, 0) for i in deps]), edges, nodes)
    assert {len(r["path"]) for r in out.collect() if r["start"] >= 10} == {7}
    assert rows_stored.get("walk", 0) + rows_stored.get("back", 0) <= len(deps)


def test_ancestors_walk_from_shared_dependencies_once(spark, rows_stored):
    """each of 100 nodes below a chain of 6 walked the chain for itself."""
    deps = {0: []} | {i: [i - 1] for i in range(1, 6)} | {i: [5, 3, 77_777] for i in range(10, 110)}
    nodes, edges = graph(spark, deps)
    out = g.ancestors(nodes.select("domain", nodes["id"].alias("start")), edges, nodes)
    got = {(r["start"], r["node"]): (r["depth"], r["path"], r["key"]) for r in out.collect()}
    assert len(got) == sum(range(1, 7)) + 100 * 7
    assert got[10, 2] == (2, [10, 3, 2], [1, 0]) and got[10, 4] == (2, [10, 5, 4], [0, 0]) and got[10, 10] == (0, [10], [])
    assert rows_stored["walk"] <= 30


def test_a_missing_target_of_many_edges_is_looked_up_once(spark, rows_stored):
    """all edges to one missing node met in one task; null targets stay dangling."""
    nodes, edges = graph(spark, {0: []} | {i: [999, 0, None] for i in range(1, 80)})
    assert sorted((r["dst"] or -1) for r in g.dangling(edges, nodes).collect()) == [-1] * 79 + [999] * 79
    assert rows_stored["lost"] == 1
    assert {r["dst"] for r in g.among(edges, nodes).collect()} == {0}


def test_the_best_by_common_terms_are_ranked_once(spark, monkeypatch):
    """queries that share common terms each met all documents of those; the best are those of all scores."""
    from tessera.operators import retrieval as r

    rng = random.Random(3)
    text = lambda i: " ".join([f"own{i // 2}", *rng.choices(["red", "green", "blue", "grey"], k=rng.randrange(1, 6))])
    rows = [(i, "xy"[i % 2], text(i)) for i in range(160)] + [(500, "x", ""), (501, "y", None)]
    docs = spark.createDataFrame(rows, "doc long, domain string, text string")
    for corpus in (docs, docs.drop("domain")):
        asked = corpus.where("doc % 3 = 0").withColumnRenamed("doc", "query")
        full = r.top(r.bm25(asked, corpus), 5)
        best = r.bm25_best(asked, corpus, 5, often=4)
        key = lambda df: sorted((x["query"], x["rank"], x["doc"], round(x["score"], 9)) for x in df.collect())
        assert key(r.top(best, 5)) == key(full)
        assert best.count() < r.bm25(asked, corpus).count() / 2


def test_silent_documents_rank_without_all_scores(spark):
    """All scores of all queries were stored before a ranking; now those that it can hold."""
    from tessera.operators import retrieval as r

    scores = spark.createDataFrame([(1, d, 1.0 + d % 7) for d in range(10, 90)] + [(2, 3, 0.5)], "query long, doc long, score double")
    docs = spark.createDataFrame([(d,) for d in range(90)], "doc long")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query long")
    rows = r.with_silent(scores, asked, docs, 4)
    assert rows.count() <= 3 * 8
    got = {q: [x["doc"] for x in r.top(rows, 4).where(f"query = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    assert got == {1: [13, 20, 27, 34], 2: [3, 0, 1, 2], 3: [0, 1, 2, 3]}


def test_labels_that_begin_alike_do_not_meet_all_texts(spark, monkeypatch):
    """every text met every label by their first three characters; the pairs tested are few now."""
    from pyspark.sql import functions as F

    labels = [f"supplier#{i:06d}" for i in range(150)] + ["a", "us", "usa nation"]
    nodes = spark.createDataFrame([(D, i, x, [], "T", i) for i, x in enumerate(labels)], g.NODE_SCHEMA)
    texts = [x.upper() if i % 3 == 0 else f"about {x} today" if i % 3 == 1 else x[:-1] for i, x in enumerate(labels)] + ["s", "ab", "zzz", " ", "supplier#0000", "supplier#0000"]
    got = {r["key"]: (r["node"], r["tier"]) for r in g.resolve(spark.createDataFrame([(D, i, x) for i, x in enumerate(texts)], "domain string, key int, text string"), nodes).collect()}

    def plain(s):
        for tier, holds in enumerate((lambda t: t == s, lambda t: s in t, lambda t: t in s)):
            for i, t in enumerate(labels):
                if holds(t):
                    return i, tier

    want = {i: plain(x.lower().strip()) for i, x in enumerate(texts) if x.strip()}
    assert got == {k: v for k, v in want.items() if v}
    monkeypatch.setattr(g.F, "contains", lambda t, s: F.lit(True))  # what is left are the pairs to test: 15 texts met 150 labels each
    texts = spark.createDataFrame([(D, x[:-1], x[:-1]) for x in labels[:150]], "domain string, i string, s string").distinct()
    assert g._contained(texts, nodes.select("domain", F.col("id").alias("o"), F.col("label").alias("t"))).count() == 150


def _shuffled(df):
    """The plan as text, for what happens before a shuffle."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_beyond_the_cap_go_before_the_shuffle(spark):
    """All distinct sources of a label were shuffled before the cap; repeated ones do not take places."""
    from tessera.operators import build as b

    kinds = "seq long, nct_id string, url string, source_hash string, conditions array<string>, interventions array<struct<name:string>>, primary_outcomes array<struct<measure:string,description:string>>, secondary_outcomes array<struct<measure:string,description:string>>, phases array<string>, status string, sponsor string"
    rows = [(i, f"N{i}", f"u{i // 2:03d}", "h", ["Pain", "pain"], [], [], [], [], "S", "") for i in range(40)]
    out = b.provenance(spark.createDataFrame(rows, kinds), 3)
    plan = _shuffled(out)
    assert plan.count("WindowGroupLimit") == 2 and "HashAggregate" not in plan.split("WindowGroupLimit", 1)[-1]
    got = {(r["taxonomy_id"], r["key"]): [s["url"] for s in r["sources"]] for r in out.collect()}
    assert got[("COND", "pain")] == got[("STATUS", "s")] == ["u000", "u001", "u002"]


def test_mentions_are_counted_without_a_sort(spark):
    """the first sight of a label was a struct, for which all mentions were sorted in memory; order and nulls stay."""
    from tessera.operators import build as b

    kinds = "seq long, conditions array<string>, interventions array<struct<name:string>>, primary_outcomes array<struct<measure:string,description:string>>, secondary_outcomes array<struct<measure:string,description:string>>, phases array<string>, status string, sponsor string"
    far = (1 << 63) - 1
    rows = [(far, ["b", "a"]), (-far - 1, ["d"]), (7, ["c", "a"]), (None, ["e"]), (far, ["b2"])]
    trials = spark.createDataFrame([(i, c, [], [], [], ["P"], "S", "") for i, c in rows], kinds)
    out = b.ranked_labels(b.attribute_labels(trials, ()), ["taxonomy_id"]).where("taxonomy_id = 'COND'")
    assert "SortAggregate" not in _shuffled(out) and "HashAggregate" in _shuffled(out)
    assert [r["label"] for r in out.orderBy("place").collect()] == ["a", "e", "d", "c", "b", "b2"]


def test_long_texts_are_cleaned_once(spark):
    """a trial's long texts were cleaned by a pattern in each of the places that read them."""
    from tessera.functions import text as t
    from tessera.operators import build as b

    texts = ["plain  two", "a b", " a b ", "", None, "a\u00a0b", "a\x1fb", "x\t\r\ny", "é è", "word " * 600, "\x85 q \u3000", "a\u2003 b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string")
    assert df.where(~t.squeeze(F.col("s")).eqNullSafe(t.squeeze_long("s"))).count() == 0
    row = {f: None for f in ("title", "url", "status", "enrollment", "sponsor", "detailed_description", "eligibility_criteria")}
    kind = ", ".join([f"{c} string" for c in ("nct_id", "brief_summary", *row)] + ["search_terms array<string>, conditions array<string>, phases array<string>, interventions array<struct<name:string,type:string,description:string>>, primary_outcomes array<struct<measure:string,description:string>>, secondary_outcomes array<struct<measure:string,description:string>>"])
    trials = spark.createDataFrame([(f"N{i}", x, *row.values(), [], [], [], [], [], []) for i, x in enumerate(texts)], kind)
    out = b.trial_markdown(trials)
    assert _shuffled(out).count("regexp_replace") <= 3
    told = {r["nct_id"]: r["markdown"] for r in out.collect()}
    assert told["N0"].endswith("\n\nSummary: plain two") and "Summary" not in told["N4"] and told["N9"].endswith("...") and told["N5"].endswith("a b")


def test_a_hubs_dependents_are_joined_in_runs(spark):
    """all rows of a hub were gathered in one list; now at most those of 4096 ids."""
    far = [7, 5000, 4096, 123_456]
    nodes = spark.createDataFrame([(D, 1, "Hub", [], "T", 1)] + [(D, i, f"NCT{i:08d} x", [1], "T", i) for i in far], g.NODE_SCHEMA)
    out = g.node_documents(nodes, g.edges_of(nodes))
    assert "shiftright" in _shuffled(out)
    hub = out.where("node_id = 1").first()
    assert hub["nct_ids"] == [f"NCT{i:08d}" for i in sorted(far)]
    assert "; ".join(f"NCT{i:08d} x [T]" for i in sorted(far)) in hub["text"]


def test_batches_of_vector_blocks_are_bounded(spark):
    """a batch held as many pairs of blocks as it had rows."""
    from tessera.operators import retrieval as r

    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(600)], "doc long, vector array<double>")
    out = r.nearest(vectors.withColumnRenamed("doc", "query"), vectors, 2)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("16m", str(16 << 20))
    assert sorted(r_["doc"] for r_ in out.where("query = 8").collect()) == [4, 9]


def test_only_texts_with_a_likely_run_are_multiplied(spark):
    """all runs of all texts were shuffled, and texts again to be tested; canonical texts took two patterns."""
    from pyspark.sql import functions as F

    from tessera.functions import text as t
    from tessera.plans import scoring_queries as q

    rng = random.Random(5)
    word = lambda: rng.choice("abcde")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 3, 3, 4, 5, 5, 6, 7, 7))] + [(20, "zz y x w v"), (21, "q")]
    docs = [(i % 35, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, "zz y x w v u"), (91, "zz y x w"), (None, "q"), (92, ""), (93, "zzz y x w v")]
    found = q._held(spark.createDataFrame(docs, "doc_id long, c string"), spark.createDataFrame(items, "item_id int, t string"))
    want = sorted((str(d), i) for d, c in docs for i, x in items if f" {x} " in f" {c} ")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found.collect()) == want
    many = spark.createDataFrame([(i, " ".join(f"own{i}_{k}" for k in range(50))) for i in range(40)], "doc_id long, c string")
    plan = q._held(many, spark.createDataFrame(items, "item_id int, t string"))
    assert plan.count() == 0 and "filter(" in _shuffled(plan)
    none = spark.createDataFrame([], "item_id int, t string")
    assert q._held(many, none).count() == 0
    odd = spark.createDataFrame([(x,) for x in ("A\x85b", " x-y__z\t\n", " É́!?", "İ 5½", "", "\x1c　-", None, "a - b", "日本 語、x", "𝒜 👍 b")], "s string")
    two = t.squeeze(F.regexp_replace(F.lower("s"), t.NOT_WORD, " "))
    assert odd.where(~two.eqNullSafe(t.canonical(F.col("s")))).count() == 0


def test_runs_of_words_are_made_in_compiled_code(spark):
    """each run of each text was hashed and looked up by interpreted lambdas, and a text was made canonical before it was split again."""
    from pyspark.sql import functions as F

    from tessera.functions import text as t
    from tessera.plans import scoring_queries as q

    rng = random.Random(7)
    word = lambda: rng.choice(["Ab", "ab", "É", "x_y", "7"])
    blank = lambda: rng.choice([" ", ", ", "\u00a0-", "\n"])
    texts = ["".join(word() + blank() for _ in range(rng.randrange(40))) for _ in range(30)]
    long = "one two three four five six seven eight"
    texts += [None, "", "...", "-x_y", f"({long})", f"{long[:-6]}.", "Five, six"] + ["again: one two THREE four five; " * 30] * 2
    items = [*("".join(word() + blank() for _ in range(n)) for n in (1, 1, 2, 3, 4, 5, 5, 6)), long, long, "one two three four five", "five six", "?"]
    docs = spark.createDataFrame([(i % 30, x) for i, x in enumerate(texts)], "doc_id long, text string").withColumn("c", t.canonical(F.coalesce("text", F.lit(""))))
    asked = spark.createDataFrame([(i // 2, x) for i, x in enumerate(items)], "item_id int, text string").select("item_id", t.canonical(F.col("text")).alias("t")).where("t <> ''")
    want = sorted((d["doc_id"], x["item_id"]) for d in docs.collect() for x in asked.collect() if f" {x['t']} " in f" {d['c']} ")
    found = q._held(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("c")), asked)
    assert "transform(" not in _shuffled(found) and "regexp_replace" not in _shuffled(found) and "LeftSemi" in _shuffled(found)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want and len(want) > len(set(want)) > 50
    # with many items, words and places are shuffled, whole texts are not
    many = asked.unionAll(spark.range(storage.FEW).selectExpr("CAST(id AS INT)", "concat('only', id, ' a b c d e')"))
    found = q._held(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("c")), many)
    assert "SortMergeJoin" in _shuffled(found) and sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == want


def test_no_pairs_ask_for_no_search(spark, rows_stored):
    """the whole graph was made ready both ways for questions that no one asked."""
    nodes, edges = graph(spark, {0: []} | {i: [0] for i in range(1, 50)})
    none = spark.createDataFrame([], "domain string, a long, b long")
    out = g.path_neighbourhood(none, edges, nodes)
    assert out.count() == 0 and "both" not in rows_stored and "steps" not in rows_stored
    asked = spark.createDataFrame([(D, 3, 4)], "domain string, a long, b long")
    some = g.path_neighbourhood(asked, edges, nodes)
    assert some.schema.simpleString() == out.schema.simpleString() and some.count() == 3 and rows_stored["both"] == 98
