"""Maximum inner product search with score-aware anisotropic quantisation.

A quantiser trained for inner products should spare the error parallel to the
vector, which shifts its score with the queries that matter, more than the
error across it.  Vectors are product-quantised, two dimensions to a four-bit
code; code books and codes both minimise

    w_par * (r . x / |x|)**2 + w_perp * |r - (r . x / |x|) x / |x||**2,

``r`` being the residual.  A query looks its products with all code words up in
tables, two codes (a byte) at a time, sums them for every vector, and the best
of each block go on to exact scoring in double precision.

The code books are fitted on a bounded sample of SAMPLE vectors, chosen by the
hash of their id; every vector is indexed.  Index and queries are stored in the
shared folder as blocks of bounded size; every query block meets every index
block, and a task holds one of each.

Candidates of a block are the vectors whose approximate score reaches the
RERANK-th best, ties included, so equal vectors are never parted and ties are
settled by exact score and id.

Every query block meets every index block: on vectors without structure a
coarse partition has to probe most of its cells before recall reaches 0.9, so
none is used; the work is queries times vectors at a byte a dimension pair.

Defined results: a vector that is null, zero, of another length than most of
the candidates, or holds null or non-finite numbers takes no part, nor does one
without id; integer and decimal vectors are read as doubles; rows
that repeat a query's id are the query's own; equal query rows are one query,
and where an id has several vectors each row counts once, by the best of its
scores with them; other repeated rows each take a
place; an empty table gives an empty result; columns other than id and vector
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ship, stored, table

SAMPLE = 20_000
RERANK = 400
BLOCK, QUERIES = 16_384, 1_024
_AT_ONCE = 128


@dataclass(frozen=True)
class Quantiser:
    """books[s, c]: code word c of subspace s; ``dim`` is that of the vectors."""

    books: np.ndarray
    dim: int
    parallel: float

    def _split(self, x: np.ndarray) -> np.ndarray:
        s, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, s * w - self.dim))).reshape(len(x), s, w)

    def assign(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """Codes (n, s) by coordinate descent on the anisotropic loss."""
        parts = self._split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        codes = np.empty(parts.shape[:2], dtype=np.int64)
        own = np.zeros(parts.shape[:2])  # each subspace's share of r . x / |x|
        rows = np.arange(len(x))
        for sweep in range(sweeps):
            for s, book in enumerate(self.books):
                r = parts[:, s, None, :] - book[None]
                square = (r * r).sum(axis=2)
                along = (r * unit[:, s, None, :]).sum(axis=2)
                rest = own.sum(axis=1) - own[:, s]
                loss = square + (self.parallel - 1) * (rest[:, None] + along) ** 2 if sweep else square
                codes[:, s] = best = loss.argmin(axis=1)
                own[:, s] = along[rows, best]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, queries, 256): the product of each query with what a byte stands for."""
        one = np.einsum("qsw,scw->sqc", self._split(q), self.books)
        return (one[0::2, :, None, :] + one[1::2, :, :, None]).reshape(len(one) // 2, len(q), 256).astype(np.float32)


def train(x: np.ndarray, threshold: float = 0.2, width: int = 2, rounds: int = 10) -> Quantiser:
    """Alternates assignment and weighted least squares for the code words.

    ``threshold``: the share of the largest possible score above which errors
    matter; it sets the weight of the parallel error to (d - 1) t^2 / (1 - t^2).
    """
    n, dim = x.shape
    parallel = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    s = -(-dim // width)
    s += s % 2
    rng = np.random.default_rng(7)
    books = np.zeros((s, 16, width))
    start = Quantiser(books, dim, parallel)
    parts = start._split(x)
    for k in range(s):
        books[k] = parts[rng.choice(n, 16, replace=n < 16), k] + rng.normal(scale=1e-6, size=(16, width))
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for step in range(rounds):
        now = Quantiser(books, dim, parallel)
        codes = now.assign(x, 1 if step < 3 else 2)
        along = np.stack([((parts[:, k] - books[k][codes[:, k]]) * unit[:, k]).sum(axis=1) for k in range(s)], axis=1)
        books = books.copy()
        for k in range(s):
            u, p = unit[:, k], parts[:, k]
            rest = along.sum(axis=1) - along[:, k]
            outer = u[:, :, None] * u[:, None, :]
            a, b = np.zeros((16, width, width)), np.zeros((16, width))
            np.add.at(a, codes[:, k], np.eye(width) + (parallel - 1) * outer)
            np.add.at(b, codes[:, k], p + (parallel - 1) * u * (rest + (u * p).sum(axis=1))[:, None])
            used = np.bincount(codes[:, k], minlength=16) > 0
            books[k][used] = np.linalg.solve(a[used] + 1e-9 * np.eye(width), b[used][:, :, None])[:, :, 0]
            along[:, k] = ((p - books[k][codes[:, k]]) * u).sum(axis=1)
    return Quantiser(books, dim, parallel)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that may take part, as doubles where they are not floats."""
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    vector = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def common_length(rows: DataFrame) -> int:
    """The commonest length of the vectors of ``usable`` rows, of equally common ones the greatest; 0 without rows."""
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sizes[0]["d"] if sizes else 0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(rows: DataFrame, size: int, quantiser: Quantiser | None) -> DataFrame:
    """One row for each ``size`` vectors of a partition: ids, vectors, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def emit(i: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            codes = quantiser.pack(quantiser.assign(x.astype(np.float64))) if quantiser else np.empty(0, dtype=np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (i, x, codes)], names=["ids", "vectors", "codes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            vectors.append(_matrix(batch.column(1)))
            while sum(map(len, ids)) >= size:
                i, x = np.concatenate(ids), np.concatenate(vectors)
                yield emit(i[:size], x[:size])
                ids, vectors = [i[size:]], [x[size:]]
        if sum(map(len, ids)):
            yield emit(np.concatenate(ids), np.concatenate(vectors))

    return rows.select("id", "v").mapInArrow(run, "ids binary, vectors binary, codes binary")


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, quantiser: Quantiser, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the ids, exact scores and places of its k best in one block."""
    columns = packed.T.astype(np.intp)
    wide = np.ascontiguousarray(x.T.astype(np.float64))
    keep = min(len(ids), rerank + 1)  # one more, for the query itself
    for a in range(0, len(q), _AT_ONCE):
        some = q[a : a + _AT_ONCE].astype(np.float64)
        tables = quantiser.tables(some)
        rough = np.zeros((len(some), len(ids)), dtype=np.float32)
        for byte, column in zip(tables, columns, strict=True):
            rough += np.take(byte, column, axis=1)
        least = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
        for i, own in enumerate(q_ids[a : a + _AT_ONCE]):
            at = np.flatnonzero((rough[i] >= least[i]) & (ids != own))
            exact = np.zeros(len(at))
            for d in range(len(wide)):  # left to right, so that equal vectors score alike
                exact += wide[d, at] * some[i, d]
            top = np.lexsort((ids[at], -exact))[:k]
            yield np.full(len(top), own), ids[at][top], exact[top], at[top]


def search(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product."""
    spark = candidates.sparkSession
    ship(spark)
    rows = usable(candidates, id_col, vec_col)
    right = F.size("v") == common_length(rows)
    kind = rows.schema["v"].dataType
    rows, asked = rows.where(right), usable(queries, id_col, vec_col).where(right).select("id", F.col("v").cast(kind).alias("v")).distinct()
    real = np.dtype({"float": np.float32, "double": np.float64}[kind.elementType.simpleString()])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], result)
    quantiser = train(np.array([r["v"] for r in sample], dtype=np.float64))
    index = stored(_blocks(rows, BLOCK, quantiser).withColumn("block", F.monotonically_increasing_id()), "index")
    ask = stored(_blocks(asked, QUERIES, None), "queries").select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                q_ids, ids = (np.frombuffer(raw[i], dtype=np.int64) for i in (0, 2))
                q, x = np.frombuffer(raw[1], dtype=real).reshape(len(q_ids), -1), np.frombuffer(raw[3], dtype=real).reshape(len(ids), -1)
                packed = np.frombuffer(raw[4], dtype=np.uint8).reshape(len(ids), -1)
                found = list(best_of(q_ids, q, ids, x, packed, quantiser, k, rerank))
                columns = [pa.array(np.concatenate([f[i] for f in found])) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), raw[5]))], names=["query_id", "vec_id", "score", "at", "block"])

    pairs = ask.crossJoin(index)  # blocks of the stated query set against blocks of all rows
    found = pairs.select("q_ids", "q_vectors", "ids", "vectors", "codes", "block").mapInArrow(run, "query_id long, vec_id long, score double, at long, block long")
    found = found.groupBy("query_id", "vec_id", "block", "at").agg(F.max("score").alias("score"))  # a row found by several vectors of a query
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return search(rows.where("vec_id % 20 = 0"), rows)
