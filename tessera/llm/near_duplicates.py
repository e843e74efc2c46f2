"""Near duplicates by SuperMinHash, banding, exact verification and union-find.

1. Every text gives its set of 5-word shingles, a SuperMinHash signature and
   one key for each band.  Texts with equal sets form a class, named by a
   number that its 128-bit set key gets once; one text goes on for each class,
   so copies cost nothing more.
2. Classes that share a band key are a bucket.  In a few rounds every bucket
   takes a centre, the same for buckets with the same members, and the members
   that are not yet known to be in the centre's component are compared with it
   on full shingle sets.  Confirmed links are united after each round, so a
   bucket of copies of one text is settled by comparisons linear in its size.
3. What no round has settled is compared pair by pair, in blocks of bounded
   size: the members outside the last centre's component with each other and
   with those inside.  A bucket of ``o`` such members among ``n`` sends
   ``o * n / BLOCK_ROWS`` rows.  So every two classes that share a band key
   are compared or are already linked through others, whatever the sizes.
4. Tasks hand on union-find forests, never pairs, and the forests are joined
   into components.  Each component is named by its least doc_id at the end.

With 25 bands of 4 slots a pair at similarity 0.85 shares no key with
probability 1e-8, one at 0.8 with 1e-6.

Defined results: null, empty and white-space texts have no shingles and are
linked with nothing.  Rows are judged each by its own text: repeated rows each
get a result, and rows that share an id but not the text may be in different
components.  Rows with a null id link like all others; they never name a
component, and one of null ids alone is named null.  Very long texts are read
whole; a task holds one block at a time.  An empty table gives an empty result.
Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import joined, ship, stored, table
from tessera.llm.components import components, union_find
from tessera.llm.superminhash import band_keys, jaccard_links, set_key, shingle_set, signature

BANDS, ROWS = 25, 4
#: Rounds in which buckets are compared with a centre.
ROUNDS = 2
#: A block's most members and shingles on average; both bound a task's memory.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 400_000
#: Columns of the incidence matrix that are multiplied at once.
_COLUMNS = 2048


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Two columns that tell rows apart by id and text, 96 bits together."""
    own = F.col(id_col).cast("long")
    return [F.xxhash64(own, F.col(text_col)).alias("h"), F.hash(F.col(text_col), own).alias("g")]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands = [], [], []
        known: dict[bytes, list[int]] = {}
        for text in batch.column(3).to_pylist():
            s = shingle_set(text)
            sizes.append(len(s))
            keys.append(k := set_key(s))
            if len(s) and k not in known:
                known[k] = band_keys(signature(s, BANDS * ROWS), BANDS)
            bands.append(known.get(k, []))
        made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "h", "g", "n_shingles", "set_key", "bands"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, g, n_shingles, set_key and band keys of each row; one pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_keys(id_col, text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, h long, g int, n_shingles long, set_key binary, bands array<long>")


def _links(sets: list[np.ndarray], left: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Positions of all linked pairs; with both sides present, only across them."""
    n = len(sets)
    across = left.any() and not left.all()
    if n <= 6:
        for i in range(n):
            for j in range(i):
                if not (across and left[i] == left[j]) and jaccard_links(sets[i], sets[j], percent):
                    yield j, i
        return
    sizes = np.array([len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = counts >= 2  # a shingle of one set alone adds to no intersection
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rows, cols = (np.flatnonzero(left), np.flatnonzero(~left)) if across else (np.arange(n),) * 2
    common = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for a in range(0, int(shared.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + _COLUMNS])
        m = np.zeros((n, _COLUMNS), dtype=np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        common += m[rows] @ m[cols].T
    common = common.astype(np.int64)
    total = sizes[rows][:, None] + sizes[cols][None, :] - common
    i, j = np.nonzero(100 * common >= percent * total)
    a, b = rows[i], cols[j]
    yield from ((int(x), int(y)) for x, y in zip(a, b, strict=True) if across or x < y)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (pair, node, set_key, left, text) arrive sorted by pair."""
        pair = None
        held: dict[int, tuple[np.ndarray, bool]] = {}

        def flush() -> pa.RecordBatch:
            nodes = list(held)
            found = union_find((nodes[i], nodes[j]) for i, j in _links([held[x][0] for x in nodes], np.array([held[x][1] for x in nodes], dtype=bool), percent))
            edges = [(x, r) for x, r in found.items() if x != r]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([r for _, r in edges], pa.int64())], names=["u", "v"])

        for batch in batches:
            for p, node, key, left, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if p != pair:
                    if len(held) > 1:
                        yield flush()
                    held.clear()
                    pair = p
                if node not in held:
                    s = shingle_set(text)
                    if set_key(s) == key:  # else another row of the same id
                        held[node] = (s, left)
        if len(held) > 1:
            yield flush()

    return run


def _n_blocks(rows, shingles):
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _compared(dealt: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The forest (u, v) of the links among ``dealt``: pair, node, left."""
    rows = texts.join(dealt, "node").select("pair", "node", "set_key", "left", "text")
    return stored(rows.repartition("pair").sortWithinPartitions("pair", "node").mapInArrow(_verify(percent), "u long, v long"), "links")


def _stars(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair, node, left) that compares each node with its centre; a hub's members are dealt to several blocks.

    ``pairs``: node, centre, distinct, stored.
    """
    sizes = pairs.join(texts.select("node", "n_shingles"), "node").groupBy("centre").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("centre", "n", _n_blocks(F.col("n"), F.col("s")).alias("blocks"))
    name = lambda block: F.concat_ws("/", "centre", block).alias("pair")
    members = joined(pairs, sizes, "centre", pairs.count()).select(name(F.pmod(F.xxhash64("node"), "blocks")), "node", F.lit(False).alias("left"))
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return members.unionByName(centres.select(name(F.col("block")), F.col("centre").alias("node"), F.lit(True).alias("left")))


def _rest(tagged: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair, node, left) that compares, in each bucket of ``tagged`` (band, node, root, main), the
    members outside its main component with each other and with those inside."""
    out = F.col("root") != F.col("main")
    rows = tagged.join(texts.select("node", "n_shingles"), "node")
    shingles = lambda which: F.sum(F.when(which, F.col("n_shingles")).otherwise(0))
    stats = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.count_if(out).alias("o"), _n_blocks(F.count_if(out), shingles(out)).alias("ob"), _n_blocks(F.count_if(~out), shingles(~out)).alias("mb"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"),
    )
    # buckets with the same members (told by number, sum and xor of their hashes) are compared once
    once = stats.groupBy("n", "o", "s1", "s2").agg(F.min(F.struct("band", "ob", "mb")).alias("x")).select("x.*", "n")
    rows = stored(joined(rows.select("band", "node", out.alias("out")), once, "band", rows.count()), "open")
    own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), "ob")).otherwise(F.pmod(F.xxhash64("node"), "mb")).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    name = lambda kind, a, b: F.concat_ws("/", "band", F.lit(kind), a, b).alias("pair")
    among = rows.where("out").select("band", "node", "own", upto("ob")).select(name("o", F.least("own", "other"), F.greatest("own", "other")), "node", (F.col("own") <= F.col("other")).alias("left"))
    across = rows.where("out").select("band", "node", "own", upto("mb")).select(name("m", F.col("own"), F.col("other")), "node", F.lit(True).alias("left"))
    inside = rows.where("not out").select("band", "node", "own", upto("ob")).select(name("m", F.col("other"), F.col("own")), "node", F.lit(False).alias("left"))
    return among.unionByName(across).unionByName(inside)


def confirmed(docs: DataFrame, classes: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): the component of every class that has a confirmed link.

    ``classes``: node, set_key, n_shingles, bands, and h and g of one of its rows.
    """
    member = classes.select("node", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(joined(member, sizes, "band", classes.count() * BANDS), "buckets")
    total = met.count()
    wanted = classes.select("node", "set_key", "n_shingles", "h", "g").join(met.select("node").distinct(), "node")
    rows = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).join(wanted.hint("shuffle_hash"), ["h", "g"])
    texts = stored(rows.groupBy("h", "g", "node", "set_key", "n_shingles").agg(F.first("text").alias("text")), "texts")  # repeated rows
    tagged, links = met.withColumn("root", F.col("node")), None
    for turn in range(ROUNDS + 1):
        by = F.xxhash64("node", F.lit(turn))
        chosen = tagged.groupBy("band").agg(F.min_by("node", by).alias("centre"), F.min_by("root", by).alias("main"), F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"))
        chosen = stored(chosen.where("a <> b").select("band", "centre", "main", "n"), "centres")
        if chosen.isEmpty():  # every bucket lies within one component
            break
        tagged = joined(tagged.select("band", "node", "root"), chosen, "band", total).drop("n")
        if turn < ROUNDS:
            dealt = _stars(stored(tagged.where("root <> main").select("node", "centre").distinct(), "stars"), texts)
        else:
            dealt = _rest(stored(tagged, "tagged"), texts)
        new = _compared(dealt, texts, percent)
        links = new if links is None else links.toDF("u", "v").unionByName(new)
        links = components(links)
        if turn < ROUNDS:  # a bucket of two is settled by its centre
            tagged = stored(met.where("n > 2").join(links, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root")), "tagged")
    return classes.sparkSession.createDataFrame([], "node long, root long") if links is None else links


def _judged(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, g, n_shingles, component_id and kept of every row."""
    rows = stored(sketches(docs, id_col, text_col), "sketches")
    some = rows.where("n_shingles > 0")
    first = F.min_by(F.struct("h", "g"), F.struct("h", "g"))
    classes = some.groupBy("set_key").agg(first.alias("x"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "x.h", "x.g", "least", "n", "n_shingles", "bands"), "classes")
    found = confirmed(docs, classes, percent, id_col, text_col)
    alone = classes.select("node", "set_key", "least", "n").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    alone = stored(alone, "components")
    named = alone.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = joined(alone.select("root", "set_key", F.col("n").alias("rows")), named, "root", alone.count()).select("set_key", "component_id", F.col("rows").alias("n"))
    cols = ["doc_id", "h", "g", "n_shingles", "component_id"]
    linked = joined(some.select("doc_id", "h", "g", "n_shingles", "set_key"), named, "set_key", rows.count()).select(*cols)
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*cols)
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links pairs with ``100 * intersection >= percent * union``.
    """
    return _judged(docs, percent, id_col, text_col).drop("h", "g")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one document stays.

    Links at a similarity of 0.8 or more.  Rows are dropped each by its own id
    and text; rows equal in both are one document and stay together; in a group
    of null ids alone all stay, as no id can name one of them.
    """
    del spark, sf_dir
    gone = _judged(docs, 80).where("not kept").select(F.col("h").alias("_h"), F.col("g").alias("_g")).distinct()
    h, g = row_keys()
    return docs.join(gone, (h == F.col("_h")) & (g == F.col("_g")), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws
  FROM documents),
t AS (SELECT rid, unnest(ws) AS v, unnest(range(len(ws))) AS i FROM w),
f AS (SELECT rid, concat_ws(' ', v, lead(v) OVER o, lead(v, 2) OVER o, lead(v, 3) OVER o, lead(v, 4) OVER o) AS g, lead(v, 4) OVER o AS z, i FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
x AS (SELECT DISTINCT rid, md5_number(g) AS g FROM f JOIN w USING (rid) WHERE z IS NOT NULL OR (i = 0 AND len(ws) < 5)),
s AS (SELECT doc_id, w.rid, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT rid, count(*) AS n FROM x GROUP BY 1) y ON y.rid = w.rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s m ON m.rid = a JOIN s n ON n.rid = b WHERE 100 * k >= 85 * (m.n + n.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rid, rid AS r FROM s UNION SELECT c.rid, e.b FROM c JOIN e ON c.r = e.a),
d AS (SELECT c.rid, min(s.doc_id) AS component_id FROM c JOIN s ON s.rid = c.r GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN d USING (rid)
"""
