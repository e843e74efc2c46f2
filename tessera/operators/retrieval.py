"""Passage retrieval: windows, BM25, flat vector search, rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import registry_ids, tokens
from tessera.storage import joined_by, stored


def pieces(text: Column) -> Column:
    """A text cut into words, each with the blanks before it; joined they are the text again, but for its last blanks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\s*\S+"), F.lit(0))


def windows(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 20, tokenize: Callable[[Column], Column] = pieces) -> DataFrame:
    """source, start_token, n_tokens, text: overlapping windows of each text, as it was written.

    ``docs``: source, text and any others, which are kept.  ``tokenize`` cuts a
    text into parts that, joined, are the text.  Windows of fewer than
    ``least`` tokens are left out; the last window is the first one that
    reaches the end.
    """
    step = size - overlap
    each = docs.withColumn("_t", tokenize(F.col("text"))).drop("text").withColumn("_n", F.size("_t")).where("_n > 0")
    starts = each.withColumn("start_token", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(step))))
    kept = starts.where((F.col("start_token") == 0) | (F.col("start_token") - step + size < F.col("_n")))
    part = F.slice("_t", F.col("start_token") + 1, F.lit(size))
    rest = [c for c in docs.columns if c != "text"]
    return kept.select(*rest, "start_token", F.size(part).alias("n_tokens"), F.array_join(part, "").alias("text")).where(F.col("n_tokens") >= least)


def bpe_windows(docs: DataFrame, ranks: str, pattern: str, size: int = 512, overlap: int = 50, least: int = 20) -> DataFrame:
    """``windows`` by the tokens of a byte-pair encoding; bytes cut apart at a border read as U+FFFD.

    ``docs``: source, text.  ``ranks``: the content of a tiktoken vocabulary
    file, which goes out to the workers with the function.
    """
    step = size - overlap
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        listed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line)}
        encoding = tiktoken.Encoding("windows", pat_str=pattern, mergeable_ranks=listed, special_tokens={})
        for batch in batches:
            out: list[tuple] = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoding.encode_ordinary(text or "")
                for start in range(0, max(len(ids) - overlap, min(len(ids), 1)), step):
                    part = ids[start : start + size]
                    if len(part) >= least:
                        out.append((source, start, len(part), encoding.decode(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["source", "start_token", "n_tokens", "text"])

    kind = docs.schema["source"].dataType.simpleString()
    return docs.select("source", "text").mapInArrow(run, f"source {kind}, start_token int, n_tokens int, text string")


def prose_documents(found: DataFrame) -> DataFrame:
    """Documents of ``windows`` of a corpus (domain, source, start_token, text): their ids, numbers and texts."""
    name = F.concat_ws(":", "domain", F.lit("prose"), "source", F.col("start_token").cast("string"))
    none = F.array().cast("array<string>").alias("taxonomy_ids")
    return found.select(name.alias("document_id"), "domain", F.lit("prose_chunk").alias("kind"), F.col("source").cast("string").alias("source"), registry_ids(F.col("text")).alias("nct_ids"), none, "text")


def postings(docs: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """doc, term, tf, and the other columns of ``docs`` but its text."""
    rest = [c for c in docs.columns if c not in ("text", "term", "tf")]
    return docs.select(*rest, F.explode(tokenize(F.col("text"))).alias("term")).groupBy(*rest, "term").agg(F.count("*").alias("tf"))


def _weighted(queries: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The postings of asked terms (doc, length, term, tf), dealt by document;
    the terms of each query (query, term, times, df, weight, mean); the columns of a corpus."""
    by = ["domain"] if "domain" in queries.columns and "domain" in docs.columns else []
    one = docs.select("doc", "text", *by)
    lengths = stored(one.select("doc", *by, F.size(tokens(F.col("text"))).alias("n")).groupBy(*by, "doc").agg(F.sum("n").cast("long").alias("length"), F.count("*").alias("rows")), "lengths")
    wanted = stored(queries.select("query", *by, F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", *by, "term").agg(F.count("*").alias("times")), "wanted")
    terms = joined_by(wanted.select(*by, "term").distinct(), "terms")
    each = one.select("doc", *by, F.explode(tokens(F.col("text"))).alias("term")).join(terms, [*by, "term"], "left_semi")
    found = each.groupBy(*by, "doc", "term").agg(F.count("*").alias("tf"))
    index = stored(found.join(lengths.drop("rows").hint("merge"), [*by, "doc"]), "postings")
    some = lambda df: df.withColumn("_all", F.lit(1)) if not by else df
    on = by or ["_all"]
    corpus = some(lengths).groupBy(*on).agg(F.sum("rows").alias("n"), F.sum("length").alias("total"))  # one row a domain
    df = index.groupBy(*by, "term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = some(wanted.join(df, [*by, "term"])).join(corpus, on)
    return index, asked.select("query", *by, "term", "times", "df", (F.col("times") * idf).alias("weight"), (F.col("total") / F.col("n")).alias("mean")), by


def _summed(pairs: DataFrame, by: list[str], k1: float, b: float) -> DataFrame:
    """query, doc, score of postings that stand beside the query terms they answer."""
    tf = F.col("tf")
    part = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return pairs.groupBy(*by, "query", "doc").agg(F.sum(part).alias("score")).drop(*by)


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, doc, score of the documents that share a term with the query.

    ``queries``: query, text; ``docs``: doc, text.  With a column ``domain`` on
    both sides every domain is a corpus of its own: its statistics are those of
    its documents, and its queries see no others.  A term counts as often as
    the query repeats it.  The postings of asked terms are dealt by document
    once, with its length; where the query terms are few they go to every task,
    so a document's scores are summed where its postings lie.
    """
    index, asked, by = _weighted(queries, docs)
    pairs = index.repartition(*by, "doc").join(joined_by(asked.drop("times", "df"), "asked"), [*by, "term"])
    return _summed(pairs, by, k1, b)


def bm25_best(queries: DataFrame, docs: DataFrame, k: int, often: int = 1000, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The scores of ``bm25`` that the k best of each query are among, without those of all pairs.

    A term is common if more than ``often`` documents hold it.  A document with
    none of a query's other terms scores what the common ones give; of those
    only the k best by the common terms can be among the k best, as every term
    adds to a score.  Queries that ask the same common terms share that
    ranking.  Documents with one of the other terms are all scored.
    """
    index, asked, by = _weighted(queries, docs)
    asked = stored(asked, "asked")
    common = asked.where(F.col("df") > often)
    sets = stored(common.groupBy(*by, "query").agg(F.array_sort(F.collect_list(F.struct("term", "times"))).alias("set")), "sets")
    first = sets.groupBy(*by, "set").agg(F.min("query").alias("first"))
    like = sets.join(first, [*by, "set"]).select(*by, "query", "first")
    shared = common.join(first.select(*by, F.col("first").alias("query")), [*by, "query"], "left_semi").drop("times", "df")
    ranked = top(_summed(index.join(joined_by(shared, "shared"), [*by, "term"]), by, k1, b), k).select(F.col("query").alias("first"), "doc")
    rare = index.join(asked.where(F.col("df") <= often).select("query", *by, "term").hint("merge"), [*by, "term"]).select(*by, "query", "doc")
    chosen = like.join(joined_by(ranked, "ranked"), "first").select(*by, "query", "doc").unionByName(rare).distinct()
    terms = chosen.join(asked.drop("times", "df").hint("merge"), [*by, "query"])
    return _summed(terms.join(index.hint("merge"), [*by, "doc", "term"]), by, k1, b)


def top(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query, doc, score, rank: the k best of each query, ties to the smaller doc."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_silent(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best ``scores`` of each query and, since documents without a score
    rank too, the first k documents of the query's corpus by id, with score 0
    where they have none; no ranking of k can hold others.
    """
    by = ["domain"] if "domain" in queries.columns and "domain" in docs.columns else []
    if by:
        first = F.row_number().over(Window.partitionBy("domain").orderBy("doc"))
        zeros = queries.select("query", "domain").distinct().join(docs.select("domain", "doc").withColumn("_k", first).where(F.col("_k") <= k), "domain").select("query", "doc")
    else:
        few = docs.select("doc").orderBy("doc").limit(k)
        zeros = queries.select("query").distinct().crossJoin(F.broadcast(few))  # k rows are broadcast
    zeros = stored(zeros, "silent")
    scores = scores.select("query", "doc", "score")
    best = top(scores, k).drop("rank")
    early = scores.join(F.broadcast(zeros.select("doc").distinct()), "doc", "left_semi").join(zeros, ["query", "doc"], "left_semi")  # k documents a corpus
    rows = best.unionByName(early.select(*best.columns)).unionByName(zeros.withColumn("score", F.lit(0.0)))
    return rows.groupBy("query", "doc").agg(F.max("score").alias("score"))


def first_chunks(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """query, doc, score, rank: a dry run of retrieval, the first k documents by id with score 0 for every query."""
    few = docs.select("doc").orderBy("doc").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("doc")))
    return queries.select("query").crossJoin(F.broadcast(few)).select("query", "doc", F.lit(0.0).alias("score"), "rank")  # k rows are broadcast


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """domain and one row for each ``size`` vectors of it: keys and values as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            domain = batch.column(0).to_pylist()
            cuts = [i for i in range(len(domain)) if not i or domain[i] != domain[i - 1]]
            for begin, end in zip(cuts, [*cuts[1:], len(domain)], strict=True):
                for a in range(begin, end, size):
                    part = batch.slice(a, min(size, end - a))
                    flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([domain[a]], pa.string()), pa.array([part.column(1).to_numpy().tobytes()]), pa.array([flat.tobytes()])], names=["domain", "keys", "flat"])

    return vectors.mapInArrow(run, "domain string, keys binary, flat binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, size: int = 4096) -> DataFrame:
    """query, doc, score, rank: the k largest inner products by a flat scan.

    ``queries``: query, vector; ``vectors``: doc, vector, all of one length and
    without nulls.  With a column ``domain`` on both sides a query meets the
    blocks of its own domain alone, in an equi-join.  Else the stated query set
    meets all vectors block by block; a task holds one block of each and hands
    on k rows for each of its queries.  Batches are bounded in bytes
    and read in place, one pair of blocks at a time.
    """
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    by = "domain" in queries.columns and "domain" in vectors.columns
    own = F.col("domain").cast("string") if by else F.lit(None).cast("string").alias("domain")
    sorted_ = lambda df: df.repartition("domain").sortWithinPartitions("domain") if by else df
    ask = _packed(sorted_(queries.select(own, F.col("query").cast("long"), "vector")), 256).toDF("domain", "q_keys", "q_flat")
    index = stored(_packed(sorted_(vectors.select(own, F.col("doc").cast("long"), "vector")), size), "vectors")
    pairs = ask.join(index, "domain").drop("domain") if by else ask.drop("domain").crossJoin(index.drop("domain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                qk, qf, dk, df = (batch.column(i)[row].as_buffer() for i in range(4))
                q, d = np.frombuffer(qk, dtype=np.int64), np.frombuffer(dk, dtype=np.int64)
                score = np.round(np.frombuffer(qf).reshape(len(q), -1) @ np.frombuffer(df).reshape(len(d), -1).T, 9)
                best = [np.lexsort((d, -s))[:k] for s in score]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, [len(x) for x in best])), pa.array(np.concatenate([d[x] for x in best])), pa.array(np.concatenate([s[x] for s, x in zip(score, best, strict=True)]))], names=["query", "doc", "score"])

    return top(pairs.mapInArrow(run, "query long, doc long, score double"), k)


def fuse(rankings: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """query, doc, score, rank by summed 1 / (k + rank) over several rankings."""
    return top(rankings.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), limit, 12)


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic reranker: query tokens that the text holds."""
    both = F.array(F.struct(tokens(query).alias("q"), F.array_distinct(tokens(text)).alias("d")))  # tokens are made once, not for each element
    return F.transform(both, lambda s: F.size(F.filter(s["q"], lambda x: F.array_contains(s["d"], x))))[0].cast("double")


def rerank(fused: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 5, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """query, doc, rrf_score, rerank_score, rank: best by rerank score, then fused score, then doc."""
    both = fused.select("query", "doc", F.col("score").alias("rrf_score")).join(queries.select("query", F.col("text").alias("_q")), "query").join(docs.select("doc", F.col("text").alias("_d")), "doc")
    scored = both.withColumn("rerank_score", score(F.col("_q"), F.col("_d")))
    order = Window.partitionBy("query").orderBy(F.desc("rerank_score"), F.desc(F.round("rrf_score", 12)), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "doc", "rrf_score", "rerank_score", "rank")


def eligible(queries: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores`` with filter: queries that name registry numbers keep the
    documents that share one; if none does, all stay.

    ``docs``: doc, ids (array); the numbers meet in an equi-join.
    """
    asked = queries.select("query", F.explode(registry_ids(F.col("text"))).alias("id"))
    held = docs.select("doc", F.explode("ids").alias("id"))
    match = asked.join(held, "id").select("query", "doc").distinct()
    some = match.select("query").distinct().withColumn("_some", F.lit(True))
    found = scores.join(match.withColumn("_hit", F.lit(True)), ["query", "doc"], "left").join(some, "query", "left")
    kept = found.where(F.col("_some").isNull() | F.col("_hit").isNotNull())
    return kept.select("query", "doc", "score", F.when(F.col("_some").isNotNull(), "domain+id").otherwise("domain").alias("filter"))


def trace(chosen: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """``chosen`` with the ranks it had in each list, null where absent."""
    place = lambda df, name: df.select("query", "doc", F.col("rank").alias(name))
    return chosen.join(place(lexical, "bm25_rank"), ["query", "doc"], "left").join(place(dense, "dense_rank"), ["query", "doc"], "left")


def contexts(chosen: DataFrame, docs: DataFrame, label: str = "Document") -> DataFrame:
    """query, context: the chosen texts in rank order under their names."""
    told = chosen.join(docs.select("doc", "text"), "doc").withColumn("_t", F.concat(F.lit(f"[{label}: "), F.col("doc").cast("string"), F.lit("]\n"), "text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"])
    return told.groupBy("query").agg(F.array_join(parts, "\n\n---\n\n").alias("context"))


# Which kind of system answers which type of question.
ROUTES = {"T1_entity": "passages", "T2_dependency": "graph", "T3_path": "graph", "T4_aggregate": "graph", "T5_cross_concept": "passages"}


def route(rows: DataFrame, routes: dict[str, str] | None = None) -> DataFrame:
    """One row for each question: that of the system its type goes to.

    ``rows``: id, type, system and more; ``routes``: the system of each type.
    """
    target = None
    for kind, system in (routes or ROUTES).items():
        target = F.when(F.col("type") == kind, system) if target is None else target.when(F.col("type") == kind, system)
    return rows.where(F.col("system") == target).withColumn("source_system", F.col("system")).withColumn("system", F.lit("router"))
