"""Quality rules by weak supervision, with built-in functions only.

Each rule looks at one property of a text and votes good (1), bad (-1) or
abstains (0).  Expectation-maximisation over the votes of all documents
estimates how often every rule is right, and a document is kept when its
posterior probability of being good reaches a threshold, so one noisy rule
cannot reject a document that the others vouch for.

Documents with equal votes are alike to the model, so EM runs over the
histogram of vote patterns: at most ``3 ** len(RULES)`` rows reach the driver,
however many documents there are, and the estimate is that of all documents.

Defined results: a null or empty text has no words and fails the base test;
a very long text is one row like others; repeated rows each get their own
result; an empty table gives an empty result; columns other than the id and the
text are ignored, whatever their names.

The prior is held to 0.5 or more, as most documents of a corpus worth filtering
are taken to be good; where most are bad, the posterior is too kind, and only
the base test and strong votes reject.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, bind, stored, table, words

SYMBOLS = "#*$%&|<>"


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows found twice or more; ``w`` is bound.

    Windows of one text are sorted by their 64-bit hash, so that equal ones
    are neighbours; their starts, in order, then give the covered words.
    """

    def covered(s: Column) -> Column:
        found = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(found, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    at = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), at))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(windows, covered))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row of counts for each document, with the columns of ``keep``; no shuffle, one pass over the text."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *keep)
    counted = base.select(
        "_id",
        *keep,
        bind(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        without(".,;:!?").cast("long").alias("n_marks"),
    )
    return counted.select(F.col("_id").alias(id_col), F.col("_w.n_words"), "word_chars", "n_symbols", F.col("_l.n_dup_lines"), F.col("_w.n_repeat_words"), F.col("_l.n_lines"), "n_upper", "n_marks", *keep)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: SQL conditions over the columns of ``features``.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("repeated_lines", "n_lines > 1 and 10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", "word_chars between 3 * n_words and 12 * n_words"),
    Rule("sentence_marks", "n_words >= 100 and 200 * n_marks < n_words or 2 * n_marks > n_words", "50 * n_marks >= n_words and 3 * n_marks <= n_words"),
)


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents and, for each rule, how often its vote is right."""

    prior: float
    accuracy: tuple[float, ...]

    def posterior(self, votes: Sequence[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(votes, self.accuracy, strict=True))
        return 1 / (1 + math.exp(-odds))


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = 50, start: float = 0.7, floor: float = 0.55, ceiling: float = 0.99) -> VoteModel:
    """EM over (votes, number of documents).

    A rule's abstentions say nothing of the document.  Accuracies stay in
    ``[floor, ceiling]`` and the prior in ``[0.5, ceiling]``: rules are taken to
    be better than chance, which also settles which of EM's two mirror-image
    solutions is meant.
    """
    m = len(patterns[0][0]) if patterns else 0
    model = VoteModel(0.5, (start,) * m)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, right, cast = 0.0, [0.0] * m, [0] * m
        for votes, n in patterns:
            p = model.posterior(votes)
            good += n * p
            for j, v in enumerate(votes):
                if v:
                    cast[j] += n
                    right[j] += n * (p if v > 0 else 1 - p)
        clamp = lambda x, low: min(max(x, low), ceiling)
        model = VoteModel(clamp(good / total, 0.5), tuple(clamp(r / c, floor) if c else start for r, c in zip(right, cast, strict=True)))
    return model


def votes(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


def fit_rules(counted: DataFrame, rules: Sequence[Rule] = RULES) -> VoteModel:
    """The vote model of a table of ``features``; one aggregation of tiny rows."""
    cols = [votes(r).alias(f"v{j}") for j, r in enumerate(rules)]
    rows = counted.select(*cols).groupBy(*[f"v{j}" for j in range(len(rules))]).count().collect()
    return fit(sorted((tuple(int(x) for x in r[: len(rules)]), int(r["count"])) for r in rows))


def judge(counted: DataFrame, model: VoteModel, rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality_probability and kept to ``features``."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for r, a in zip(rules, model.accuracy or (0.5,) * len(rules), strict=True):
        odds = odds + votes(r) * F.lit(math.log(a / (1 - a)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("quality_probability", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Counts, posterior and verdict for each document.

    The counts are stored once in the shared folder; the model's aggregation
    and the verdicts both read those narrow rows and not the texts again.
    """
    counted = stored(features(docs, id_col, text_col), "quality-features")
    return judge(counted, fit_rules(counted, rules), rules, threshold)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    Rows are stored once beside their counts; the model reads the counts alone
    and every row is judged where it is, so no text is shuffled.
    """
    del spark, sf_dir
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # whatever the names, none clashes
    name = dict(zip(docs.columns, plain.columns, strict=True))
    counted = features(plain.withColumn("_key", F.lit(0)), "_key", name["text"], plain.columns)
    counted = stored(counted, "quality-rows")
    kept = judge(counted, fit_rules(counted)).where("kept")
    return kept.select(*[F.col(name[c]).alias(c) for c in docs.columns])
