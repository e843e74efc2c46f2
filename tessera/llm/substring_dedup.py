"""Removal of word windows that occur more than once in the corpus.

Level-wise doubling.  The levels are window lengths, each twice the one before,
clipped to the asked length: 9, 18 and 35 words for 35.  Windows repeated at one
length alone are extended to the next, and only those are counted there, until
no candidate survives or the asked length is reached.  Longer windows are unions
of windows of the asked length, so no level beyond it can change a verdict.

A level need not count every window: each window chooses, by the least hash, one
window of the level below inside it.  Equal windows choose alike, so a window
can only recur if its choice does.  About one word in nine starts a chosen
window of 18 words, and fewer start one of 9.

Equal windows met by one task are settled there: the task hands on one row for
them all, so a passage that a third of all documents share sends as many rows
to one place as there are tasks and not documents.  Texts with a candidate at
the first level are stored once; the other texts are not read again.

Windows are told apart by 64-bit hashes, another one at every level: two
different windows pass for equal only if they agree at the last level, both
being repeated at every level below; among ``c`` candidates there, about
``c * c / 2**65`` pairs do.  Rows are told apart by 96 bits of id and text, so
rows that repeat an id are separate documents unless their texts are equal too,
when each makes the other's windows repeated.

Defined results: null, empty and shorter texts than a window lose nothing;
identical texts of a window or more lose all their words; very long texts are
read whole, one at a time; an empty table gives an empty result; only the id and
the text are read, so other columns cannot clash; a null id is a name like any
other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE_RUN, SPACES, drop, ship, stored, table, words
from tessera.llm.superminhash import mix, word_hashes

#: Windows that a task holds before it settles and hands on what it has.
HELD = 500_000
_BASE = 0x9E3779B97F4A7C15
#: Windows of a task: hash, the two keys of the row, first start and number of starts.
_RUNS = "h long, row long, row2 int, start int, n int"
KEYS = ["row", "row2"]
#: No level has shorter windows.
LEAST = 9


def window_hashes(w: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each start."""
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done = w, 1  # sums of ``done`` words each, made longer bit by bit of ``length``
    for bit in bin(length)[3:]:
        out = out[:-done] + out[done:] * np.uint64(pow(_BASE, done, 1 << 64))
        done *= 2
        if bit == "1":
            out = out[:-1] + w[done:] * np.uint64(pow(_BASE, done, 1 << 64))
            done += 1
    return mix(out)


def _least(g: np.ndarray, length: int) -> np.ndarray:
    """Where the least of the ``length`` values from each start is, the first of equal ones."""
    if len(g) < length:
        return np.zeros(0, dtype=np.int64)
    at, done = np.arange(len(g)), 1
    while done < length:
        step = min(done, length - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        done += step
    return at


def levels(length: int, least: int = LEAST) -> list[int]:
    """Window lengths, each at most twice the one before; the last is ``length``."""
    out = [length]
    while out[0] >= 2 * least - 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def choices(w: np.ndarray, sizes: list[int], sure: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each level the starts of the windows that may count there; and, but for
    the first level, for each of these the start of its choice on the level below.

    ``sure``: the starts of the windows of the last level, where ``w`` holds more texts than one.
    """
    starts, picks = [np.arange(len(w) - sizes[-1] + 1) if sure is None else sure], []
    for upper, lower in zip(sizes[:0:-1], sizes[-2::-1], strict=True):
        pick = _least(window_hashes(w, lower), upper - lower + 1)[starts[0]]
        picks.insert(0, pick)
        chosen = np.zeros(len(w), dtype=bool)
        chosen[pick] = True
        starts.insert(0, np.flatnonzero(chosen))
    return starts, picks


class _Settler:
    """Gathers (hash, row, start) and settles equal hashes within the task.

    A row is known by two keys.  Hands on: (h, row, start) of a hash met once; (h, null) once for a hash met
    again; and, without h, runs (row, start, n) of windows known to be repeated.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows: list[np.ndarray] = []
        self.rows2: list[np.ndarray] = []
        self.size = self.n_rows = 0

    def add(self, h: np.ndarray, of: np.ndarray, start: np.ndarray, row: np.ndarray, row2: np.ndarray) -> None:
        """``of``: which of the rows ``row``, ``row2`` each window is of, in their order."""
        if len(h):
            self.parts.append((h, of + self.n_rows, start))
            self.rows.append(row)
            self.rows2.append(row2)
            self.n_rows += len(row)
            self.size += len(h)

    def flush(self) -> pa.RecordBatch:
        h, of, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        row, row2 = np.concatenate(self.rows), np.concatenate(self.rows2)
        h, start = h.view(np.int64), start.astype(np.int32)
        self.__init__()
        order = np.argsort(h)
        ranked = h[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        alone = new & np.r_[new[1:], True]
        once = np.empty(len(h), dtype=bool)
        once[order] = alone
        again, known = ~once, ranked[new & ~alone]
        of2, start2 = of[again], start[again]  # in the order of rows and starts
        new = np.flatnonzero(np.r_[True, (of2[1:] != of2[:-1]) | (start2[1:] != start2[:-1] + 1)]) if len(of2) else np.empty(0, dtype=np.int64)
        n2 = np.diff(np.r_[new, len(of2)])
        a, b, c = int(once.sum()), len(known), len(new)
        null = lambda *runs: np.concatenate([np.full(k, bool(v)) for k, v in runs])
        zero = lambda k: np.zeros(k, dtype=np.int64)
        rows = lambda key: pa.array(np.concatenate([key[of[once]], np.zeros(b, dtype=key.dtype), key[of2[new]]]), mask=null((a, 0), (b, 1), (c, 0)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([h[once], known, zero(c)]), mask=null((a + b, 0), (c, 1))),
                rows(row),
                rows(row2),
                pa.array(np.concatenate([start[once], zero(b), start2[new]]).astype(np.int32)),
                pa.array(np.concatenate([np.ones(a + b, dtype=np.int64), n2]).astype(np.int32)),
            ],
            names=["h", "row", "row2", "start", "n"],
        )


#: Words of several texts that are worked on at once; a longer text is worked on alone.
AT_ONCE = 50_000


def _run_arrays(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which row each run is of, its start and its number of starts."""
    flat = runs.flatten()  # null rows have none
    of = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()) * ~np.asarray(runs.is_null()))
    return of, flat.field("start").to_numpy(), flat.field("n").to_numpy()


def _covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the ranges."""
    edge = np.bincount(begin, minlength=size + 1) - np.bincount(end, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def _level(sizes: list[int], k: int):
    """Settles the windows of level ``k``; above the first, of those whose choice below is in ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Settler()
        for batch in batches:
            row, row2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            runs = _run_arrays(batch.column(3)) if k else None
            found: list[np.ndarray] = []  # of neighbouring texts, about AT_ONCE words
            first = size = 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                w = word_hashes(text, lower=False)
                if size and size + len(w) > AT_ONCE:
                    _gather(held, found, first, row, row2, runs, sizes, k)
                    found, first, size = [], i, 0
                    if held.size >= HELD:
                        yield held.flush()
                found.append(w)
                size += len(w)
            if found:
                _gather(held, found, first, row, row2, runs, sizes, k)
            if held.size >= HELD:
                yield held.flush()
        if held.size:
            yield held.flush()

    return run


def _gather(held: _Settler, found: list[np.ndarray], first: int, row: np.ndarray, row2: np.ndarray, runs: tuple | None, sizes: list[int], k: int) -> None:
    """Adds the windows of level ``k`` of the texts ``found``, rows ``first`` and on of their batch."""
    lengths = np.array([len(w) for w in found])
    ends = np.cumsum(lengths)
    begins, w = ends - lengths, np.concatenate(found)
    text = np.repeat(np.arange(len(found)), lengths)
    places = np.arange(len(w))
    starts, picks = choices(w, sizes, np.flatnonzero(places + sizes[-1] <= ends[text]))
    at = starts[k]
    if runs is not None:
        low, high = np.searchsorted(runs[0], [first, first + len(found)])
        of, begin, n = (x[low:high] for x in runs)
        begin = begin + begins[of - first]
        at = at[_covered(len(w), begin, begin + n)[picks[k - 1]]]
    if len(at):
        of = text[at]
        last = first + len(found)
        held.add(window_hashes(w, sizes[k])[at], of, at - begins[of], row[first:last].copy(), row2[first:last].copy())


def _repeated(settled: DataFrame) -> DataFrame:
    """(row, row2, runs): the repeated starts of each row, as arrays of (start, n)."""
    open_ = settled.where("h is not null").withColumn("met", F.count("*").over(Window.partitionBy("h")))
    found = open_.where("met > 1 and row is not null").select(*KEYS, "start", "n")
    found = found.unionAll(settled.where("h is null").select(*KEYS, "start", "n"))
    return found.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _gone(n: int, start: np.ndarray, run: np.ndarray, length: int) -> np.ndarray:
    """Whether each of n words is covered by a window that starts in a run."""
    return _covered(n, start, np.minimum(start + run + length - 1, n))


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words removed, digest of the kept words, and the text without the removed ones."""
        for batch in batches:
            out: list[list] = [[], [], []]
            of, start, n = _run_arrays(batch.column(3))
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode()
                found = raw.split()
                gone = _gone(len(found), start[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]], length)
                out[0].append(int(gone.sum()))
                out[1].append(hashlib.sha256(b" ".join(compress(found, (~gone).tolist()))).hexdigest())
                out[2].append(_without(raw, gone))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=[*KEYS, "n_removed", "kept_sha256", "kept_text"])

    return run


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(SPACES.encode())] = True


def _without(raw: bytes, gone: np.ndarray) -> str:
    """The text without the removed words and the blanks before them."""
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    letters = np.frombuffer(raw, dtype=np.uint8)
    blank = _BLANK[letters]
    ends = np.flatnonzero(np.r_[blank[1:], True] & ~blank) + 1
    # each byte goes with the word that it is in or before; blanks before the first kept word and at the end go
    stay = np.zeros(len(raw), dtype=bool)
    stay[: ends[-1]] = np.repeat(~gone, np.diff(np.r_[0, ends]))
    before = ends[kept[0] - 1] if kept[0] else 0
    stay[before : before + int(np.argmin(blank[before:]))] = False
    return letters[stay].tobytes().decode()


def marks(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, row2, runs): the starts of the repeated windows of the rows that have any;
    and (row, row2, text) of a few more rows than those, each once.

    ``row`` and ``row2`` are the ``row_keys`` of an input row.
    """
    ship(docs.sparkSession)
    sizes = levels(length)
    texts = docs.select(*row_keys(id_col, text_col), F.col(text_col).alias("text")).where("text is not null")
    settled = stored(texts.mapInArrow(_level(sizes, 0), _RUNS), "level")
    found = stored(_repeated(settled), "runs")
    some = texts.join(found.select(*KEYS).hint("shuffle_hash"), KEYS)
    candidates = stored(some, "candidates")
    for k in range(1, len(sizes)):
        if found.isEmpty():  # no candidate survives
            break
        drop(settled)
        settled = stored(candidates.join(found.hint("shuffle_hash"), KEYS).select(*KEYS, "text", "runs").mapInArrow(_level(sizes, k), _RUNS), "level")
        last, found = found, stored(_repeated(settled), "runs")
        drop(last)
    return found, candidates


def repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, row2, n_removed, kept_sha256, kept_text) of the rows that lose words."""
    found, candidates = marks(docs, length, id_col, text_col)
    marked = candidates.join(found.hint("shuffle_hash"), KEYS).select(*KEYS, "text", "runs")
    # rows equal in id and text give equal results
    return marked.mapInArrow(_cut(length), "row long, row2 int, n_removed long, kept_sha256 string, kept_text string").dropDuplicates(KEYS)


def row_keys(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Two columns that tell rows apart by id and text, 96 bits together."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.hash(F.col(text_col), F.col(id_col)).alias("row2")]


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = repeats(docs).select(*KEYS, "n_removed", "kept_sha256")
    plain = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)), SPACE_RUN, " ")
    whole = docs.select(*row_keys(), "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.sha2(plain, 256).alias("_whole"))
    out = whole.join(lost, KEYS, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


def _cut_column(at: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batch with column ``at`` cut by the runs in its last column, which goes."""
        for batch in batches:
            out = []
            of, start, n = _run_arrays(batch.column(batch.num_columns - 1))
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            for i, text in enumerate(batch.column(at).to_pylist()):
                low, high = cuts[i], cuts[i + 1]
                if text is not None and low < high:
                    raw = text.encode()
                    text = _without(raw, _gone(len(raw.split()), start[low:high], n[low:high], length))
                out.append(text)
            kept = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names[:-1])

    return run


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated windows leave the texts; n_chars follows.

    Documents stay, also when nothing is left of them.  Each text meets its
    marks in one join and is cut there.
    """
    del spark, sf_dir
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    name = dict(zip(docs.columns, plain.columns, strict=True))
    text = name["text"]
    keyed = plain.select("*", *row_keys(name["doc_id"], text))
    joined = keyed.join(marks(docs)[0].hint("shuffle_hash"), KEYS, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = joined.select(*plain.columns, "runs").mapInArrow(_cut_column(plain.columns.index(text), 35), kinds)
    new = {"n_chars": F.when(F.col(text).isNull(), F.col(name["n_chars"])).otherwise(F.length(text))} if "n_chars" in name else {}
    return out.select(*[new.get(c, F.col(name[c])).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS ws,
         row_number() OVER () AS rid
  FROM documents),
s AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35),
g AS (SELECT s.rid, s.p, sha256(array_to_string(ws[s.p:s.p + 34], ' ')) AS h FROM s JOIN w USING (rid)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
e AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS q FROM r),
l AS (SELECT rid, list(q) AS gone FROM e GROUP BY rid)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
         list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l USING (rid)
"""
