"""URL filter, nearest neighbours, the registered SQL and the pipeline."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, components, registry, url_filter

SF = "/root/testdata/sf0.001"


def _split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fits = []
    for verdict, rule in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def _plain_judge(urls):
    k = url_filter.ORDER
    rows = [(*_split(u), *_rule(*_split(u))) for u in urls]
    count = {v: [defaultdict(Counter) for _ in range(k + 1)] for v in ("allow", "block")}

    def spots(host, path):
        s = url_filter.PAD * k + host + path + url_filter.END
        return [(s[i - k : i], s[i]) for i in range(k, len(s))]

    held = lambda host, path: hashlib.md5((host + path).encode()).hexdigest()[0] in "0123"
    for host, path, _, v in rows:
        if v and not held(host, path):
            for ctx, c in spots(host, path):
                for j in range(k + 1):
                    count[v][j][ctx[k - j :]][c] += 1

    def chance(v, ctx, c):
        p = url_filter.FLOOR
        for j in range(k + 1):
            seen = count[v][j].get(ctx[k - j :])
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    def score(host, path):
        at = spots(host, path)
        return sum(math.log(chance("allow", x, c)) - math.log(chance("block", x, c)) for x, c in at) / len(at)

    scores = [score(h, p) for h, p, _, _ in rows]
    fresh = {r[3] for r in rows if r[3] and held(*r[:2])} == {"allow", "block"}
    by = {v: np.array([s for s, r in zip(scores, rows, strict=True) if r[3] == v and (not fresh or held(*r[:2]))]) for v in ("allow", "block")}
    if not len(by["allow"]) or not len(by["block"]):
        return [(h, p, r, v or "allow") for h, p, r, v in rows]
    (ma, sa), (mb, sb) = [(by[v].mean(), by[v].std()) for v in ("allow", "block")]
    t = (ma + mb) / 2 if sa + sb == 0 else (ma * sb + mb * sa) / (sa + sb)
    return [(h, p, r, v or ("allow" if s >= t else "block")) for (h, p, r, v), s in zip(rows, scores, strict=True)]


URLS = [
    "http://a.example.com/en/12?x=1", "https://Example.COM/en/7", "https://m.b.example.com/en/77#t", "http://x.example.net/de/8", "http://example.net/de/1", "http://net/de/", "ftp://q.org/es/9/y", "http://q.org/es",
    "http://c.example.org/fr/5", "http://d.example.net/fr/5?u=1", "no scheme", "", None, "http://", "http://host", "http://host?x", "https://ü.example.net/de/ß", "http://a.example.com/en/12?x=1", "http://z.example.net/it/1", "http://a\nb.com/en/\nc",
]


def test_url_filter(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (3, URLS[3], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, gram int")
    got = url_filter.judge(df).collect()
    expected = _plain_judge([r[1] for r in rows])
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((r[0], *e) for r, e in zip(rows, expected, strict=True))
    assert url_filter.judge(df.limit(0)).count() == 0
    none = url_filter.judge(df, rules=[])
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_ann_recall_and_exactness(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows.collect()}
    got = defaultdict(list)
    for r in ann.search(rows.where("vec_id % 20 = 0"), rows, rerank=60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hit = total = 0
    for q in [i for i in data if i % 20 == 0]:
        best = sorted(((-float(data[q] @ v), i) for i, v in data.items() if i != q))[:20]
        assert [r for _, _, r in got[q]] == list(range(1, 21))
        assert all(math.isclose(s, float(data[q] @ data[i]), abs_tol=1e-12) for i, s, _ in got[q])
        assert [(-s, i) for i, s, _ in got[q]] == sorted((-s, i) for i, s, _ in got[q])
        hit += len({i for _, i in best} & {i for i, _, _ in got[q]})
        total += 20
    assert hit / total >= 0.9


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, float(i % 2)], "x") for i in range(45)] + [(100, None, ""), (101, [0.0, 0.0, 0.0], ""), (102, [nan, 1.0, 0.0], ""), (103, [inf, 1.0, 0.0], ""), (104, [1.0, None, 0.0], ""), (105, [1.0], ""), (None, [1.0, 1.0, 1.0], ""), (20, [1.0, 0.0, 0.0], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = ann.search(df.where("vec_id % 20 = 0"), df).orderBy("query_id", "rank").collect()
    of = lambda q: [r["vec_id"] for r in got if r["query_id"] == q]
    assert {r["query_id"] for r in got} == {0, 20, 40}  # ties to smaller ids, bad vectors out
    assert of(0) == list(range(1, 20)) + [20] and 20 not in of(20)
    few = spark.createDataFrame(rows[:5], df.schema)
    assert [r["vec_id"] for r in ann.search(few.where("vec_id = 0"), few).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_length_is_that_of_the_candidates(spark):
    """Queries of mixed lengths: those of the candidates' length are answered, whatever most queries have."""
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(100, [1.0]), (101, [2.0]), (102, [1.0, 1.0]), (103, [3.0])], rows.schema)
    got = ann.search(ask, rows, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(102, 29, 30.0), (102, 28, 29.0), (102, 27, 28.0)]
    whole = rows.select("vec_id", F.col("embedding").cast("array<int>").alias("embedding"))
    tens = rows.select("vec_id", F.col("embedding").cast("array<decimal(9,2)>").alias("embedding"))
    for kind in (whole, tens):
        assert [(r["vec_id"], r["score"]) for r in ann.search(kind.where("vec_id = 5"), kind, k=2).orderBy("rank").collect()] == [(29, 146.0), (28, 141.0)]
    assert ann.search(ask.where("vec_id < 102"), rows).count() == 0


def test_ann_repeated_queries(spark):
    """Equal query rows are one query; with several vectors a row counts once, by its best score."""
    rows = [(i, [1.0 + i / 64, 1.0 - i / 64]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], df.schema)
    got = ann.search(ask, df).orderBy("query_id", "rank").collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
    assert of(0) == [(i, x[0]) for i, x in sorted(rows, reverse=True)[:20]]
    assert of(1) == sorted(((i, max(x)) for i, x in rows if i != 1), key=lambda r: (-r[1], r[0]))[:20]


def test_four_bit_codes_and_tables_agree():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 9))
    quantiser = ann.train(x)
    packed = quantiser.pack(quantiser.assign(x))
    assert packed.dtype == np.uint8 and packed.shape == (500, 3)
    codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(500, -1)
    restored = np.concatenate([quantiser.books[s][codes[:, s]] for s in range(codes.shape[1])], axis=1)[:, :9]
    rough = sum(t[:, packed[:, b]] for b, t in enumerate(quantiser.tables(x[:4])))
    assert np.allclose(rough, x[:4] @ restored.T, atol=1e-4)


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, int(x)) for x in range(101, 140)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(5, 5), (100, 101)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components.union_find((a, b) for a, b in edges if a != b)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_of_queries(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in sql.description]
    got = registry.queries()[name](spark, SF).select(*cols).collect()
    assert Counter(map(tuple, got)) == Counter(sql.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[2] < seen[0]
    run = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, docs.collect()))


def test_stages_cope_with_odd_rows(spark, docs, no_docs):
    """Nulls, repeated rows, empty tables and clashing names; columns and kept rows stay as they are."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    odd = docs.withColumns({k: F.lit("x") for k in ("_rejected", "_gone", "key", "_c0", "text2", "lang_pred", "spans", "node", "word")}).drop("score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "")
        if name != "packing":
            assert out.columns == odd.columns
            if name != "substring_dedup":
                assert out.exceptAll(odd).count() == 0
        assert 0 < out.count() <= odd.count()
        assert stage(spark, no_docs, "").count() == 0
