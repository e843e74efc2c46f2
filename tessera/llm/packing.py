"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths decides the bucket boundaries: dynamic
programming finds those that pad the least in total.  Documents of a bucket
are then batched so that documents times bucket length stays in a token budget.

The histogram holds every distinct length; ``d`` of them take texts of
``d * d / 2`` words in total, so it stays small beside the corpus.  The best
last bucket never begins earlier for a greater length, so each round divides
the lengths and conquers: ``d * log(d)`` steps a bucket.  A bucket may hold a third of all rows, so its documents are
dealt by a hash of the id to lanes of about ``lane_rows`` each; numbering runs
inside a lane, and each lane ends in one partly filled batch at most.

Defined results: null, empty or white-space texts have length 0 and go to the
shortest bucket; a text longer than the budget is a batch by itself; repeated
rows take a place each; an empty table gives an empty result; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.llm.common import stored, table, words

def boundaries(histogram: Sequence[tuple[int, int]], n_buckets: int) -> list[int]:
    """Upper ends of at most ``n_buckets`` buckets with the least total padding.

    ``histogram``: (length, number of documents), by length.  The cost of a
    bucket is its documents times its upper end; what they hold is the same
    for every choice, so the least cost is the least padding.
    """
    if not histogram:
        return []
    length = np.array([x for x, _ in histogram], dtype=float)
    count = np.concatenate([[0], np.cumsum([n for _, n in histogram], dtype=float)])
    n = len(length)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    back = []
    for _ in range(min(n_buckets, n)):
        prior, least = np.zeros(n, dtype=int), np.full(n + 1, np.inf)
        todo = [(0, n, 0, n - 1)]  # lengths from, to, and where their last bucket may begin
        while todo:
            a, b, low, high = todo.pop()
            mid = (a + b) // 2
            begins = slice(low, min(mid, high) + 1)
            total = cost[begins] + (count[mid + 1] - count[begins]) * length[mid]
            at = int(total.argmin())
            prior[mid], least[mid + 1] = low + at, total[at]
            todo += [x for x in ((a, mid, low, low + at), (mid + 1, b, low + at, high)) if x[0] < x[1]]
        back.append(prior)
        cost = least
        best = cost[n] if len(back) == 1 else min(best, cost[n])
        if cost[n] == best:
            used = len(back)
    out, end = [], n
    for prior in reversed(back[:used]):
        out.append(int(length[end - 1]))
        end = int(prior[end - 1])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 8, token_budget: int = 65536, lane_rows: int = 50_000) -> DataFrame:
    """bucket, bucket_length, batch and place of each document.

    Columns: id, n_tokens (words), bucket, bucket_length, lane, batch (unique
    in the lane), place (from 0), padding.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(F.col(id_col).alias("_id"), F.size(words(F.col(text_col))).cast("long").alias("n_tokens")).withColumn("_step", F.greatest("n_tokens", F.lit(1).cast("long"))), "lengths")
    histogram = sorted((int(r[0]), int(r[1])) for r in sized.groupBy("_step").count().collect())
    ends = boundaries(histogram, n_buckets)
    rows = [(b, end, max(1, token_budget // end), max(1, -(-sum(n for x, n in histogram if x <= end and (not b or x > ends[b - 1])) // lane_rows))) for b, end in enumerate(ends)]
    plan = spark.createDataFrame(rows, "bucket int, bucket_length long, per_batch long, lanes long")  # n_buckets rows
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("_step") > end).cast("int")
    dealt = sized.withColumn("bucket", bucket).join(F.broadcast(plan), "bucket").withColumn("lane", F.pmod(F.xxhash64("_id"), F.col("lanes")))
    order = W.Window.partitionBy("bucket", "lane").orderBy("n_tokens", "_id")
    at = F.row_number().over(order) - 1
    return dealt.withColumn("_at", at).select(
        F.col("_id").alias(id_col), "n_tokens", "bucket", "bucket_length", "lane",
        F.floor(F.col("_at") / F.col("per_batch")).cast("long").alias("batch"),
        (F.col("_at") % F.col("per_batch")).cast("long").alias("place"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the place of every document in the training batches."""
    del spark, sf_dir
    return pack(docs)
