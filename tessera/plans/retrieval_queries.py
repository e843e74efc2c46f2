"""Retrieval over documents, benchmark texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import retrieval as r
from tessera.plans.catalog import table
from tessera.plans.registry import Book
from tessera.storage import stored

BOOK = Book()
_TOKENS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*'), lambda x: lower(x))"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


@BOOK.add(r"""WITH t AS (SELECT doc_id AS source, coalesce(lang, 'none') AS domain, regexp_extract_all(coalesce(text, ''), '[\s\x0b]*[^\s\x0b]+') AS t FROM documents),
s AS (SELECT source, domain, t, unnest(range(0, len(t), 462)) AS start FROM t),
c AS (SELECT source, domain, start, list_slice(t, start + 1, start + 512) AS w FROM s WHERE start = 0 OR start - 462 + 512 < len(t))
SELECT domain || ':prose:' || source || ':' || start AS document_id, domain, 'prose_chunk' AS kind, CAST(source AS VARCHAR) AS source,
  array_to_string(list_sort(list_distinct(regexp_extract_all(upper(array_to_string(w, '')), '\bNCT\d{8}\b'))), ' ') AS nct_ids, array_to_string(w, '') AS text FROM c WHERE len(w) >= 20""")
def token_windows(spark, sf_dir):
    """Overlapping windows of every document, as written; languages stand for domains."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.coalesce("lang", F.lit("none")).alias("domain"), "text")
    return r.prose_documents(r.windows(docs)).withColumn("nct_ids", F.array_join("nct_ids", " ")).drop("taxonomy_ids")


_BM25 = f"""d AS (SELECT doc_id AS doc, unnest({_TOKENS.format('text')}) AS term FROM documents),
p AS (SELECT doc, term, count(*) AS tf FROM d GROUP BY 1, 2),
l AS (SELECT doc, sum(tf) AS len FROM p GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) AS total),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query, doc, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total / n)))) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc), n GROUP BY 1, 2),
z AS (SELECT query, doc, score FROM s UNION ALL
  SELECT item_id, doc_id, 0.0 FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40) k
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query = item_id AND s.doc = k.doc_id)),
b AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM z QUALIFY rank <= 40)"""


def _lexical(spark, sf_dir, k=40):
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    return r.top(r.with_silent(r.bm25(asked, docs), asked, docs, k), k)


@BOOK.add(f"WITH {_BM25} SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM b")
def bm25_top(spark, sf_dir):
    """The forty best documents of every benchmark text."""
    return _lexical(spark, sf_dir).select("query", "doc", "rank", F.round("score", 6).alias("score"))


@BOOK.add(f"""WITH o AS (SELECT o_orderkey AS doc, o_orderstatus AS domain, o_orderpriority || ' ' || o_custkey AS text FROM orders),
a AS (SELECT doc AS query, domain, text FROM o WHERE doc % 50 = 0),
p AS (SELECT domain, doc, term, count(*) AS tf FROM (SELECT domain, doc, unnest({_TOKENS.format('text')}) AS term FROM o) GROUP BY 1, 2, 3),
l AS (SELECT domain, doc, sum(tf) AS len FROM p GROUP BY 1, 2), n AS (SELECT domain, count(*) AS n FROM o GROUP BY 1), m AS (SELECT domain, sum(len) AS total FROM l GROUP BY 1),
f AS (SELECT domain, term, count(*) AS df FROM p GROUP BY 1, 2), q AS (SELECT query, domain, term, count(*) AS times FROM (SELECT query, domain, unnest({_TOKENS.format('text')}) AS term FROM a) GROUP BY 1, 2, 3),
s AS (SELECT query, doc, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total / n)))) AS score
  FROM q JOIN f USING (domain, term) JOIN p USING (domain, term) JOIN l USING (domain, doc) JOIN n USING (domain) JOIN m USING (domain) GROUP BY 1, 2)
SELECT query, doc, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def bm25_by_domain(spark, sf_dir):
    """Every status a corpus of its own, with its own statistics."""
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderstatus").alias("domain"), F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("text"))
    asked = docs.where("doc % 50 = 0").withColumnRenamed("doc", "query")
    return r.top(r.bm25_best(asked, docs, 5), 5).select("query", "doc", F.round("score", 6).alias("score"), "rank")


@BOOK.add("""WITH k AS (SELECT doc_id AS doc, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM documents ORDER BY doc_id LIMIT 5)
SELECT item_id AS query, doc, 0.0::DOUBLE AS score, rank FROM benchmark, k""")
def dry_run_chunks(spark, sf_dir):
    """What a dry run shows in place of ranked documents."""
    return r.first_chunks(_asked(spark, sf_dir), _docs(spark, sf_dir))


_DENSE = """v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 9) AS score
  FROM v q, v d WHERE q.vec_id % 50 = 0)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    docs = rows.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return docs.where("doc % 50 = 0").withColumnRenamed("doc", "query"), docs


@BOOK.add(f"""WITH {_DENSE} SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, round(score, 6) AS score
FROM g QUALIFY rank <= 5""")
def dense_top(spark, sf_dir):
    """Flat inner-product search; queries are the ids divisible by 50."""
    return r.nearest(*_vectors(spark, sf_dir), 5).select("query", "doc", "rank", F.round("score", 6).alias("score"))


@BOOK.add("""WITH v AS (SELECT vec_id, vec_id % 7 AS domain, embedding FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2])), 9) AS score FROM v q JOIN v d USING (domain) WHERE q.vec_id % 50 = 0)
SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank, round(score, 6) AS score FROM g QUALIFY rank <= 5""")
def dense_by_domain(spark, sf_dir):
    """A query meets the vectors of its domain only."""
    ask, vectors = _vectors(spark, sf_dir)
    return r.nearest(ask.withColumn("domain", F.col("query") % 7), vectors.withColumn("domain", F.col("doc") % 7), 5).select("query", "doc", "rank", F.round("score", 6).alias("score"))


# every item's vector is a query, so that each item has both rankings
_HYBRID = f"""{_DENSE.replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")}, {_BM25},
y AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM g QUALIFY rank <= 40),
u AS (SELECT query, doc, rank FROM b UNION ALL SELECT query, doc, rank FROM y),
r AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY 1, 2),
c AS (SELECT query, doc, score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc) <= 40),
o AS (SELECT c.query, c.doc, c.score, CAST(len(list_filter({_TOKENS.format('benchmark.text')}, lambda x: list_contains({_TOKENS.format('documents.text')}, x))) AS DOUBLE) AS s
  FROM c JOIN benchmark ON item_id = query JOIN documents ON doc_id = doc),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, round(score, 12) DESC, doc) AS rank FROM o QUALIFY rank <= 5)"""


def _hybrid(spark, sf_dir):
    asked, docs = _asked(spark, sf_dir), _docs(spark, sf_dir)
    lexical = stored(_lexical(spark, sf_dir), "lexical")
    _, vectors = _vectors(spark, sf_dir)
    ask = vectors.withColumnRenamed("doc", "query").join(asked.select("query").distinct(), "query", "left_semi")
    dense = stored(r.nearest(ask, vectors, 40), "dense")
    fused = r.fuse(lexical.select("query", "doc", "rank").unionAll(dense.select("query", "doc", "rank")), 40)
    return r.rerank(fused, asked, docs), lexical, dense, docs


@BOOK.add(f"""WITH {_HYBRID} SELECT h.query, h.doc, CAST(h.rank AS INTEGER) AS rank, round(h.score, 9) AS rrf_score, s AS rerank_score,
CAST(b.rank AS INTEGER) AS bm25_rank, CAST(y.rank AS INTEGER) AS dense_rank
FROM h LEFT JOIN b ON b.query = h.query AND b.doc = h.doc LEFT JOIN y ON y.query = h.query AND y.doc = h.doc""")
def hybrid_trace(spark, sf_dir):
    """Two rankings fused and reranked; item and vector ids double as query and document ids."""
    chosen, lexical, dense, _ = _hybrid(spark, sf_dir)
    return r.trace(chosen, lexical, dense).select("query", "doc", "rank", F.round("rrf_score", 9).alias("rrf_score"), "rerank_score", "bm25_rank", "dense_rank")


@BOOK.add(f"""WITH {_HYBRID} SELECT query, string_agg('[Document: ' || doc || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM h JOIN documents ON doc_id = doc GROUP BY 1""")
def hybrid_context(spark, sf_dir):
    """What an answer model would be shown."""
    chosen, _, _, docs = _hybrid(spark, sf_dir)
    return r.contexts(chosen, docs)


@BOOK.add("""WITH q AS (SELECT o_orderkey AS query, CASE WHEN o_orderkey % 3 = 0 THEN 'What is NCT99999999?' ELSE 'What is nct' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '?' END AS text FROM orders WHERE o_orderkey % 50 = 0),
d AS (SELECT o_orderkey AS doc, 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS id FROM orders),
c AS (SELECT DISTINCT l_orderkey - l_orderkey % 50 AS query, l_orderkey AS doc FROM lineitem),
s AS (SELECT c.query, c.doc, text, id, contains(upper(text), id) AS hit FROM c JOIN q USING (query) JOIN d USING (doc)),
m AS (SELECT query, EXISTS (SELECT 1 FROM d WHERE contains(upper(text), id) AND query % 3 <> 0) AS named FROM q)
SELECT query, doc, CASE WHEN named THEN 'domain+id' ELSE 'domain' END AS filter FROM s JOIN m USING (query) WHERE hit OR NOT named""")
def registry_filter(spark, sf_dir):
    """Named numbers narrow the candidates, unknown ones do not."""
    orders = table(spark, sf_dir, "orders")
    label = F.concat(F.lit("NCT"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "What is NCT99999999?").otherwise(F.concat(F.lit("What is "), F.lower(label), F.lit("?")))
    asked = orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("query"), text.alias("text"))
    docs = orders.select(F.col("o_orderkey").alias("doc"), F.array(label).alias("ids"))
    pairs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") - F.col("l_orderkey") % 50).alias("query"), F.col("l_orderkey").alias("doc")).distinct().withColumn("score", F.lit(0.0))
    return r.eligible(asked, docs, pairs.join(asked.select("query"), "query", "left_semi")).select("query", "doc", "filter")


@BOOK.add("""WITH a AS (SELECT o_orderkey AS id, ['T1_entity','T2_dependency','T3_path','T4_aggregate','T5_cross_concept'][1 + o_orderkey % 5] AS type, o_totalprice AS value FROM orders)
SELECT id, type, CASE WHEN type IN ('T1_entity', 'T5_cross_concept') THEN 'passages' ELSE 'graph' END AS source_system,
CASE WHEN type IN ('T1_entity', 'T5_cross_concept') THEN value ELSE value * 2 END AS value FROM a""")
def routed_rows(spark, sf_dir):
    """Each question answered by the system of its type."""
    kinds = F.array(*[F.lit(x) for x in r.ROUTES])
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("type"), F.col("o_totalprice").alias("value"))
    each = base.withColumn("system", F.explode(F.array(F.lit("passages"), F.lit("graph"), F.lit("edges"))))
    rows = each.withColumn("value", F.when(F.col("system") == "graph", F.col("value") * 2).otherwise(F.col("value")))
    return r.route(rows).select("id", "type", "source_system", "value")
