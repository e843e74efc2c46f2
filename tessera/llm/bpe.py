"""BPE encoding and decoding by a pair occurrence index.

The pieces (pre-tokens) of a batch are laid out side by side as one sequence
of symbols in which no pair crosses a border.  An index maps every pair that
the merge table knows to the set of its positions.  The active rank that is
least is applied to all its positions in one go; each merge takes the two
neighbouring pairs out of their lists and enters the two new ones, which may
activate further ranks.  The work ends when no rank is active.

The result is that of the tokenizer file: same normalisation, pieces, special
tokens and ids, no truncation or padding.  A merge may bring up a rank below
the one being applied; the piece concerned then waits, so that each piece sees
its merges in the order it would see alone.

Pieces recur, so a worker keeps those it has encoded, in a table of bounded
size; the index handles the new pieces of a batch together.

Defined results: a null text is encoded like an empty one, to no ids;
repeated rows each get a result; an empty table gives an empty result; only
the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ship, table

#: Pieces that a worker remembers, and texts whose new pieces are encoded together.
REMEMBERED, TOGETHER = 400_000, 1_000
#: White space of the tokenizer's regular expressions.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = re.compile(_BLANK + "+")
#: Lower-case letters of texts that need neither composition nor Unicode classes, and the check for such texts.
_LATIN = "a-z\xdf-\xf6\xf8-\xff\u0153"
_PLAIN = re.compile("[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff\u0152\u0153]*").fullmatch
#: Ranges whose classes or cases changed between Unicode versions.
_UNSETTLED = regex.compile(r"[\u0530-\u058f\u0860-\u08ff\u0c00-\u0cff\u1c80-\u1c8f\u2080-\u209f\ua7c0-\ua7ff\uab30-\uab6f\U00010000-\U0001f2ff\U0001fb00-\U0001ffff\U0002a6e0-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file: NFC, blanks, lower case; pieces by pattern; byte-level BPE with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError("this kind of tokenizer file is not covered")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self._merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        m = np.array(self._merges, dtype=np.int64).reshape(-1, 3)
        order = np.argsort(m[:, 0] << 32 | m[:, 1], kind="stable")
        self._keys, self._key_rank = (m[:, 0] << 32 | m[:, 1])[order], order
        self._lowest = np.full(max(self.vocab.values()) + 1, len(m))  # of a symbol's pairs, the least rank
        for side in (0, 1):
            np.minimum.at(self._lowest, m[:, side], np.arange(len(m)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.path, self._lib = path, None
        self._letters = byte_letters()
        self._byte = {x: i for i, x in enumerate(self._letters)}
        if any(x not in self.vocab or x + self.end not in self.vocab for x in self._letters):
            raise ValueError("the vocabulary lacks single bytes")
        self._first = np.array([self.vocab[x] for x in self._letters], dtype=np.int32)
        self._last = np.array([self.vocab[x + self.end] for x in self._letters], dtype=np.int32)
        self._pieces = regex.compile(pattern.replace(r"\s", _BLANK[1:-1]))
        self._plain = re.compile(pattern.replace(r"\s", " ").replace(r"\p{L}", _LATIN).replace(r"\p{N}", "0-9"))
        self._split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self._known: dict[str | int, tuple[int, ...]] = {}

    def normalise(self, text: str) -> str:
        """NFC, each run of blanks one blank, lower case letter by letter (no final sigma)."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return _BLANKS.sub(" ", text).replace("Σ", "σ").lower()

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text without special tokens.

        Letters that Unicode versions class differently are left to the
        library's own normaliser and splitter.
        """
        if _PLAIN(text):
            return self._plain.findall(_BLANKS.sub(" ", text).lower())
        if _UNSETTLED.search(text):
            shown = self._library().pre_tokenizer.pre_tokenize_str(self._library().normalizer.normalize_str(text))
            return [bytes(self._byte[c] for c in p).decode() for p, _ in shown]
        return self._pieces.findall(self.normalise(text))

    def _library(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def pieces(self, text: str) -> list[str | int]:
        """Pieces in order; special tokens, found in the text as it is, as ids."""
        if self._split is None or not self._split.search(text):
            return self._cut(text)
        out: list[str | int] = []
        at = 0
        for m in self._split.finditer(text):
            out += self._cut(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._cut(text[at:])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, -1 if the table has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._key_rank[at], -1)

    def merge(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of some pieces, none empty; the merges apply to all at once."""
        raw = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        octets = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends, begins = np.cumsum(sizes) - 1, np.cumsum(sizes) - sizes
        symbol = self._first[octets]
        symbol[ends] = self._last[octets[ends]]
        n = len(symbol)
        word = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[ends], before[begins] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the index."""
            rank = self._ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)], strict=True):
                r = int(rank[lo])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[lo:hi])

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(r)))
            a, b, new = self._merges[r]
            j = after[at]
            at = at[(symbol[at] == a) & (j >= 0) & (symbol[j] == b)]  # a merge since may have taken either symbol
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair
                run = np.r_[True, at[1:] != after[at[:-1]]]
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            if self._lowest[new] < r and len(at) > 1:  # a lower rank may come up: one merge in a piece at a time
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(active, r)
                    at = at[first]
            if not len(at):
                continue
            j = after[at]
            k = after[j]
            symbol[at], symbol[j], after[at] = new, -1, k
            before[k[k >= 0]] = at[k >= 0]
            h = before[at]
            enter(np.unique(np.concatenate([h[h >= 0], at[k >= 0]])))
        left = np.flatnonzero(symbol >= 0)
        ids, bounds = symbol[left].tolist(), np.searchsorted(word[left], np.arange(len(raw) + 1)).tolist()
        return [tuple(ids[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        known.update((i, (i,)) for i in self.special.values())  # a special token is its own id already
        fresh = list(set().union(*cut).difference(known))
        if fresh:
            known.update(zip(fresh, self.merge(fresh), strict=True))
        return [list(chain.from_iterable(map(known.__getitem__, c))) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, special ones included; the file names no decoder."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of each row; no shuffle.

    ``path``: the tokenizer file, readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, made beside the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(np.array(x, dtype="<u4").tobytes()) for x in ids], pa.string()), pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))
