"""Language identification of mixed-language text.

Script ranges first narrow the candidate languages of each word to those seen
in that script.  The word's score under a candidate is its log-likelihood by a
character-trigram model.  Viterbi over the words, with a penalty for every
switch of language, labels spans; the text's language is the one that labels
most words and its score is that share.

Training counts trigrams (hashed to 32,768 buckets) and scripts over every
labelled training text.  What reaches the driver is languages x 32,768 counts,
whatever the corpus; the model made of them is what the tasks share.

Words here are runs of letters; case is folded.  Defined results: a null text
or one without letters is ``und`` with score 0 and no spans; so is every text
when nothing was learned; ties go to the language first by name; repeated rows
each get a result; an empty table gives an empty result; columns other than
those named are never read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, ship, table

BUCKETS = 1 << 15
#: First code points of Unicode script ranges, coarse; class 0 holds whatever is not listed.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x31F0, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))
_STARTS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
_CLASS = np.array([NAMES.index(n) for _, n in SCRIPTS], dtype=np.int64)
#: Characters handled at once.
CHUNK = 500_000


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        out[i] = chr(i).isalpha()
    return out


def _parse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket and word of each letter; script and text of each word; words of each text.

    Non-letters become blanks, so a word's first and last trigrams hold its borders.
    """
    joined = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[joined]
    c = np.where(letter, joined, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    mixed = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(17)).astype(np.int64)
    first = ~letter[at - 1]
    word = np.cumsum(first) - 1
    begins = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
    script = _CLASS[np.searchsorted(_STARTS, joined[at[first]], side="right") - 1]
    text = np.searchsorted(begins, at[first], side="right") - 1
    return bucket, word, script, text, np.bincount(text, minlength=len(texts))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters; a longer text is one by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _fold(texts: list) -> list[str]:
    return ["" if t is None else t.lower() for t in texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, feature, n) of one partition; features from BUCKETS up are scripts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), _fold(batch.column("text").to_pylist())
        for a, b in _chunks(texts):
            bucket, word, script, text, _ = _parse(texts[a:b])
            names = sorted(set(langs[a:b]))
            of = np.array([names.index(x) for x in langs[a:b]], dtype=np.int64)
            tri = np.bincount(of[text[word]] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), -1)
            scr = np.bincount(of[text] * len(NAMES) + script, minlength=len(names) * len(NAMES)).reshape(len(names), -1)
            for i, name in enumerate(names):
                counts.setdefault(name, np.zeros(BUCKETS + len(NAMES), dtype=np.int64))
                counts[name] += np.concatenate([tri[i], scr[i]])
    for name, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "feature", "n"])


class Model:
    """langs by name; logp[bucket, lang]; allowed[script, lang]."""

    def __init__(self, langs: list[str], counts: np.ndarray, switch_penalty: float, script_share: float):
        self.langs, self.switch_penalty = langs, switch_penalty
        tri, scripts = counts[:, :BUCKETS].astype(float), counts[:, BUCKETS:].astype(float)
        smooth = tri + 0.5
        self.logp = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= script_share).T
        self.allowed[~self.allowed.any(axis=1)] = True  # a script that no language claims rules none out


def train(docs: DataFrame, switch_penalty: float = 12.0, script_share: float = 0.01) -> Model:
    """The model of ``docs`` (text, lang); null texts and languages teach nothing."""
    ship(docs.sparkSession)
    rows = docs.select("text", "lang").where("text is not null and lang is not null").mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)), dtype=np.int64)
    if langs:
        counts[np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy(dtype=object)), rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts, switch_penalty, script_share)


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, the texts side by side.

    Texts are taken longest first, so those that still have a word at step t
    are a prefix; each step handles all of them at once.
    """
    order = np.argsort(-n_words, kind="stable")
    start = (np.cumsum(n_words) - n_words)[order]
    length = n_words[order]
    n, k = scores.shape
    back = np.empty((n, k), dtype=np.int32)
    out = np.empty(n, dtype=np.int64)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    own = np.arange(k, dtype=np.int32)
    best = np.zeros((len(length), k), dtype=np.float64)
    for t in range(steps):
        a = active[t]
        at, v = start[:a] + t, best[:a]
        if t:
            top = v.argmax(axis=1)
            switched = v[np.arange(a), top] - penalty
            stay = v >= switched[:, None]
            back[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, switched[:, None])
        best[:a] = v + scores[at]
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        out[at] = now[:a]
        if t:
            now[:a] = back[at, now[:a]]
    return out


def label(texts: list, model: Model) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans of each text; spans: first_word, n_words, lang."""
    langs: list[str] = []
    scores: list[np.ndarray] = []
    spans: list[list[dict]] = []
    folded, k = _fold(texts), len(model.langs)
    for a, b in _chunks(folded):
        if not k:
            langs += ["und"] * (b - a)
            scores.append(np.zeros(b - a))
            spans += [[] for _ in range(b - a)]
            continue
        bucket, word, script, text, n_words = _parse(folded[a:b])
        if len(bucket):
            each = np.add.reduceat(model.logp[bucket], np.flatnonzero(np.r_[True, word[1:] != word[:-1]]), axis=0).astype(np.float64)
            each[~model.allowed[script]] -= 1e6
            path = viterbi(each, n_words, model.switch_penalty)
        else:
            path = np.empty(0, dtype=np.int64)
        votes = np.bincount(text * k + path, minlength=(b - a) * k).reshape(b - a, k)
        top = votes.argmax(axis=1)
        langs += [model.langs[j] if n else "und" for j, n in zip(top, n_words, strict=True)]
        scores.append(votes[np.arange(b - a), top] / np.maximum(n_words, 1))
        new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])]) if len(path) else np.empty(0, dtype=np.int64)
        ends, begin = np.r_[new[1:], len(path)], np.cumsum(n_words) - n_words
        here: list[list[dict]] = [[] for _ in range(b - a)]
        for s, e, d, j in zip(new.tolist(), ends.tolist(), text[new].tolist(), path[new].tolist(), strict=False):
            here[d].append({"first_word": s - int(begin[d]), "n_words": e - s, "lang": model.langs[j]})
        spans += here
    return langs, np.concatenate(scores) if scores else np.zeros(0), spans


SPANS = "array<struct<first_word:int,n_words:int,lang:string>>"
_SPANS_PA = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, lang_pred, score and spans of each text; no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, spans = label(batch.column(batch.num_columns - 1).to_pylist(), shared.value)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS_PA)], names=[*batch.schema.names[:-1], "lang_pred", "score", "spans"])

    chosen = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double, spans {SPANS}")


def _model(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id"))))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows that are not held out and labels all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, _model(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


#: Pipeline: share of words that the language of a kept text must label.
MIN_SHARE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without a language, or of no prevailing one, go.

    A text goes if it is ``und`` or if its language labels less than MIN_SHARE
    of its words.  Verdicts are made beside the row, so nothing is joined.
    """
    del spark, sf_dir
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # whatever the names, none clashes
    name = dict(zip(docs.columns, plain.columns, strict=True))
    out = identify(plain, _model(docs), name["doc_id"], name["text"], tuple(c for c in plain.columns if c != name["doc_id"]))
    out = out.where(f"lang_pred <> 'und' and score >= {MIN_SHARE}")
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns])
