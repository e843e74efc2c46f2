"""Training-order materialisation of token sequences in binary shards.

Documents are dealt by the hash of id and text to groups, whose number follows
from the bytes of all texts, and stand in each group in the order of that hash.
Every text is tokenised and closed by an end token; the texts of a group follow
each other and are cut into sequences of ``length`` token ids, so only a
group's last sequence is padded.  Sequences are numbered densely, group by
group; a keyed Feistel permutation of the numbers, with cycle-walking down to
their exact range, gives each its global slot.  The order thus depends on the
rows and the key alone, not on files, splits or the number of tasks.

Slot ``s`` is record ``s % per_shard`` of shard ``s // per_shard``.  A record has
a fixed stride, so a reader starts at any slot by one multiplication, seeks and
reads on in sequence; ``manifest.json`` beside the shards says how.

A record is ``length`` little-endian unsigned 16-bit ids and the guard 0x0A0A,
which is the writer's line separator: Spark's own text writer stores the
records, with its commit protocol, in whatever file system the folder is in.

Numbering: sequences are stored once with their group and their place in it;
one count for each group (GROUPS at most) goes through the driver.  Shards are
dealt to tasks by ranges of slots; between tasks the sequences travel in one
compressed blob for each pair of task and shard.  A shard never holds more than
``per_shard`` records, whatever the data.

Defined results: null and empty texts are an end token alone; repeated rows
each have their tokens, side by side; a null id stands as null among a
sequence's ids; a very long text fills as many sequences as it needs; an empty
table gives an empty result and no shard; a vocabulary of more than 65,536 ids
is an error; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh_path, ship, stored, table

LENGTH, PER_SHARD, KEY, ROUNDS = 512, 8192, 20_240_229, 6
GUARD = b"\n\n"
#: Bytes of text that a group holds on average, and the most groups; beyond them groups grow.
GROUP_BYTES, GROUPS = 8 << 20, 1 << 16


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) > 0xFFFF:
        raise ValueError("records hold 16-bit ids, and the vocabulary has greater ones")
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of ``range(n)``, applied to ``x``.

    Two halves of equal width cover the least even number of bits that holds
    ``n``; values that leave the range walk on until they are back in it.
    """
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little") for r in range(rounds)]
    out = x.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys:
            f = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = left << half | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def _sequences(path: str, pattern: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text, group) arrive group by group."""
        enc = _encoding(path, pattern)
        group, place = None, 0
        owners: list = []  # ids of the texts in ``tokens``, in order
        tokens: list[np.ndarray] = []

        def cut(rest: bool) -> pa.RecordBatch:
            """The whole sequences of what is held, with ``rest`` also a shorter last one."""
            nonlocal place
            flat, ends = np.concatenate(tokens), np.cumsum([len(t) for t in tokens])
            n = -(-len(flat) // length) if rest else len(flat) // length
            begins = np.arange(n + 1) * length
            first = np.searchsorted(ends, begins[:-1], side="right")
            last = np.searchsorted(ends, np.minimum(begins[1:], len(flat)) - 1, side="right")
            parts = [flat[x : x + length] for x in begins[:-1]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([group] * n, pa.int32()), pa.array(np.arange(place, place + n)), pa.array([owners[x : y + 1] for x, y in zip(first, last, strict=True)], pa.list_(pa.int64())), pa.array([len(x) for x in parts], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                names=["group", "place", "doc_ids", "n_tokens", "ids"],
            )
            place += n
            used = min(n * length, len(flat))
            k = int(np.searchsorted(ends, used, side="right"))
            owners[:] = owners[k:]
            tokens[:] = [flat[used : ends[k]], *tokens[k + 1 :]] if k < len(tokens) else []
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(2).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(of)], strict=True):
                if group != of[lo]:
                    if tokens:
                        yield cut(True)
                    group, place = int(of[lo]), 0
                for at in range(lo, hi, 500):
                    some = batch.slice(at, min(500, hi - at))
                    owners += some.column(0).to_pylist()
                    tokens += [np.array([*enc.encode_ordinary(t or ""), end], dtype="<u2") for t in some.column(1).to_pylist()]
                    yield cut(False)
        if tokens:
            yield cut(True)

    return run


def sequences(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end: int = 50256, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """group, place, doc_ids, n_tokens and ids (16-bit) of each sequence, stored."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    groups = min(GROUPS, max(1, -(-total // group_bytes)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("doc_id", "text"), "g": F.hash("text")})
    rows = rows.withColumn("group", F.pmod("h", F.lit(groups)).cast("int"))
    rows = rows.repartition("group").sortWithinPartitions("group", "h", "g", "doc_id").select("doc_id", "text", "group")
    return stored(rows.mapInArrow(_sequences(path, pattern, length, end), "group int, place long, doc_ids array<long>, n_tokens int, ids binary"), "sequences", level=5)


def with_slots(rows: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``rows`` (group and place first) with the slot of each, and their number."""
    spark = rows.sparkSession
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("group").count().collect())  # GROUPS rows at most
    total = sum(n for _, n in sizes)
    begins = dict(zip([s for s, _ in sizes], np.cumsum([0, *[n for _, n in sizes]])[:-1].tolist(), strict=True))
    begin = spark.sparkContext.broadcast(begins)
    schema = T.StructType([*rows.schema.fields, T.StructField("slot", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                start = np.array([begin.value[s] for s in batch.column(0).to_pylist()], dtype=np.int64)
                slot = feistel(start + batch.column(1).to_numpy(), total, key)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    return rows.mapInArrow(run, schema), total


def _deal(length: int, per_shard: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One compressed blob for each shard that a batch has sequences of."""
        squeeze = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(0).to_numpy()
            order = np.argsort(slots, kind="stable")
            slots, data = slots[order], batch.column(1).take(pa.array(order)).to_pylist()
            shard = slots // per_shard
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            fill = np.array([pad], dtype="<u2").tobytes()
            blobs = []
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(slots)], strict=True):
                body = b"".join(x + fill * (length - len(x) // 2) for x in data[lo:hi])
                blobs.append(squeeze.compress(slots[lo:hi].tobytes() + body))
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    return run


def _records(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, record) in the order of the slots; blobs arrive sorted by shard."""
        now, blobs = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            slots, bodies = [], []
            for raw in map(zstandard.ZstdDecompressor().decompress, blobs):
                n = len(raw) // (8 + 2 * length)
                slots.append(np.frombuffer(raw, dtype=np.int64, count=n))
                bodies.append(np.frombuffer(raw, dtype=np.uint8, offset=8 * n).reshape(n, -1))
            order, body = np.argsort(np.concatenate(slots)), np.concatenate(bodies)
            for a in range(0, len(order), 1024):
                part = [body[i].tobytes() for i in order[a : a + 1024]]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int64()), pa.array(part, pa.binary())], names=["shard", "record"])

        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != now:
                    if blobs:
                        yield from flush()
                    now, blobs = shard, []
                blobs.append(blob)
        if blobs:
            yield from flush()

    return run


def write_shards(slotted: DataFrame, folder: str, total: int, length: int = LENGTH, per_shard: int = PER_SHARD, pad: int = 50256, key: int = KEY) -> None:
    """Writes ``folder/shard=N/``, one file of fixed-stride records each, and ``folder/manifest.json``.

    Tasks take ranges of slots, each of about as many shards as the others.
    """
    spark = slotted.sparkSession
    n = -(-total // per_shard)
    tasks = max(1, min(n, 4096))
    dealt = slotted.select("slot", "ids").mapInArrow(_deal(length, per_shard, pad), "shard long, blob binary")
    task = F.floor(F.col("shard") * tasks / max(1, n)).cast("int")
    sorted_ = dealt.withColumn("task", task).repartitionById(tasks, "task").sortWithinPartitions("shard").select("shard", "blob")
    records = sorted_.mapInArrow(_records(length), "shard long, record binary")
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", GUARD.decode()).text(folder)
    about = {"length": length, "stride": 2 * length + len(GUARD), "per_shard": per_shard, "total": total, "shards": n, "key": key, "rounds": ROUNDS, "pad": pad}
    fs, path = _file_system(spark, f"{folder}/manifest.json")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    out.close()


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read_at(spark: SparkSession, path: str, at: int, n: int) -> bytes:
    """``n`` bytes of a file of any file system, from byte ``at`` on; a negative ``n``: all the rest."""
    fs, p = _file_system(spark, path)
    file = fs.globStatus(p)[0]
    stream = fs.open(file.getPath())
    try:
        stream.seek(at)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n if n >= 0 else int(file.getLen()) - at))
    finally:
        stream.close()


def manifest(spark: SparkSession, folder: str) -> dict:
    """length, stride, per_shard, total, shards, key, rounds and pad of a folder of shards."""
    return json.loads(_read_at(spark, f"{folder}/manifest.json", 0, -1))


def records_from(spark: SparkSession, folder: str, slot: int = 0, at_once: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) in training order from any slot on: what a trainer reads, and how it resumes.

    Seeks to the record and holds ``at_once`` of them; nothing before it is read.
    """
    m = manifest(spark, folder)
    while slot < m["total"]:
        shard, first = divmod(slot, m["per_shard"])
        n = min(at_once, m["per_shard"] - first, m["total"] - slot)
        raw = _read_at(spark, f"{folder}/shard={shard}/part-*", first * m["stride"], n * m["stride"])
        for ids in np.frombuffer(raw, dtype="<u2").reshape(n, -1)[:, : m["length"]]:
            yield slot, ids
            slot += 1


def read_shard(spark: SparkSession, folder: str, shard: int, first: int = 0, length: int = LENGTH) -> DataFrame:
    """(record, ids) of a shard from record ``first`` on."""
    ship(spark)
    stride = 2 * length + len(GUARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                table_ = np.frombuffer(raw, dtype="<u2").reshape(-1, stride // 2)[first:, :length].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(table_))), pa.array(table_.tolist(), pa.list_(pa.int32()))], names=["record", "ids"])

    return spark.read.format("binaryFile").load(f"{folder}/shard={shard}").select("content").mapInArrow(run, "record long, ids array<int>")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards to the shared folder and returns the place of every sequence, with the folder of its shard."""
    import public_tokenizers as tokenizers

    rows = sequences(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    slotted, total = with_slots(rows)
    folder = fresh_path(spark, "shards")
    write_shards(slotted, folder, total)
    stride = 2 * LENGTH + len(GUARD)
    places, _ = with_slots(rows.select("group", "place", "doc_ids", "n_tokens"))
    places = places.withColumn("shard", F.floor(F.col("slot") / PER_SHARD))
    return places.select("doc_ids", "n_tokens", "slot", "shard", (F.col("slot") % PER_SHARD * stride).alias("offset"), F.concat(F.lit(f"{folder}/shard="), "shard").alias("folder"))
