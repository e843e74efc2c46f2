"""Scores of an answer against the truth, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as t

# Words that the token score leaves out.
STOP_WORDS = tuple("what is a the an of for are in and or to with how does related which these those all list describe explain between concept concepts based on knowledge graph subgraph prerequisites prerequisite following".split())


def _f1(overlap: Column, predicted: Column, expected: Column) -> Column:
    return F.when(overlap == 0, F.lit(0.0)).otherwise(2.0 * overlap / (predicted + expected))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _pair(predicted: Column, expected: Column, body) -> Column:
    return _let(F.struct(predicted.alias("p"), expected.alias("x")), lambda s: body(s["p"], s["x"]))


def score_words(s: Column) -> Column:
    """The distinct words of a normalised text that count for the token score."""
    bare = F.split(t.normalize(F.coalesce(s, F.lit(""))), " ")
    return F.array_except(F.array_distinct(bare), F.array(*[F.lit(w) for w in ("", *STOP_WORDS)]))


def token_f1(predicted: Column, expected: Column) -> Column:
    """F1 of word sets: 1 if both are empty, 0 if one is."""

    def body(p: Column, x: Column) -> Column:
        overlap = F.size(F.array_intersect(p, x))
        return F.when((F.size(p) == 0) & (F.size(x) == 0), F.lit(1.0)).otherwise(_f1(overlap, F.size(p), F.size(x)))

    return F.round(_pair(score_words(predicted), score_words(expected), body), 4)


def label_set(labels: Column) -> Column:
    """Distinct canonical labels, empty ones left out."""
    return F.array_except(F.array_distinct(F.transform(F.coalesce(labels, F.array().cast("array<string>")), t.canonical_label)), F.array(F.lit("")))


def _set_scores(p: Column, x: Column) -> Column:
    overlap = F.size(F.array_intersect(p, x))
    none = F.size(x) == 0
    hit = F.when(F.size(p) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(
        F.round(F.when(none, hit).when(F.size(p) == 0, 0.0).otherwise(overlap / F.size(p)), 6).alias("precision"),
        F.round(F.when(none, hit).otherwise(overlap / F.size(x)), 6).alias("recall"),
        F.round(F.when(none, hit).otherwise(_f1(overlap, F.size(p), F.size(x))), 6).alias("f1"),
        ((overlap == F.size(p)) & (overlap == F.size(x))).alias("exact"),
    )


def set_f1(predicted: Column, expected: Column) -> Column:
    """precision, recall, f1 and exact of two label lists taken as sets.

    With nothing expected all scores are 1 if nothing was predicted, else 0.
    """
    return _pair(label_set(predicted), label_set(expected), _set_scores)


def steps(path: Column) -> Column:
    """The consecutive pairs of a path."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda a, b: F.concat(a, F.lit("\u0001"), b))


def edge_f1(predicted: Column, expected: Column) -> Column:
    """Scores of directed consecutive pairs; without expected pairs all are 0."""
    plain = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), t.canonical_label), lambda x: x != "")
    pairs = lambda c: F.array_distinct(_let(plain(c), steps))
    nothing = F.struct(F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"), F.lit(False).alias("exact"))
    return _pair(pairs(predicted), pairs(expected), lambda p, x: F.when(F.size(x) == 0, nothing).otherwise(_set_scores(p, x)))


def relation_score(kind: Column, truth: Column, labels: Column, relation: Column, first_label_only: bool = False) -> Column:
    """Scores by question type.

    T1 compares category codes with the last true label, T2 and T4 label sets,
    T3 the edges of the path from start to end (the truth is stored from end to
    start), T5 source, relation and target.  Another type is an error.
    ``first_label_only``: the older rule that T1 looks at one label only.
    """
    answers = F.slice(labels, 1, 1) if first_label_only else labels
    codes = _pair(F.array_distinct(F.transform(answers, t.taxonomy_value)), F.array(t.taxonomy_value(F.element_at(truth, -1))), _set_scores)
    named = t.canonical(relation["relation"]).isin("depends on", "depends_on", "dependency")
    right = named & (t.canonical_label(relation["source"]) == t.canonical_label(truth[0])) & (t.canonical_label(relation["target"]) == t.canonical_label(F.element_at(truth, -1)))
    hit = F.coalesce(right, F.lit(False))
    one = hit.cast("double")
    whole = F.struct(one.alias("precision"), one.alias("recall"), one.alias("f1"), hit.alias("exact"))
    wrong = F.raise_error(F.concat(F.lit("unknown question type: "), F.coalesce(kind, F.lit("null")))).cast("struct<precision:double,recall:double,f1:double,exact:boolean>")
    return F.when(kind == "T1_entity", codes).when(kind.isin("T2_dependency", "T4_aggregate"), set_f1(labels, truth)).when(kind == "T3_path", edge_f1(labels, F.reverse(truth))).when(kind == "T5_cross_concept", whole).otherwise(wrong)


def coverage(context: Column, targets: Column, exact: bool = True) -> Column:
    """The share of expected labels that the context holds; 1 if none is expected."""
    test = t.holds_term if exact else t.holds_substring
    found = F.size(F.filter(targets, lambda x: test(context, x)))
    return F.when(F.size(targets) == 0, F.lit(1.0)).otherwise(F.round(found / F.size(targets), 6))


def category_coverage(context: Column, code: Column) -> Column:
    """1 if the context holds the code or one of its aliases, else 0."""
    out = F.when(t.holds_term(context, code), 1.0)
    for name, aliases in t.TAXONOMY_ALIASES.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | t.holds_term(context, F.lit(alias))
        out = out.when((F.upper(code) == name) & hit, 1.0)
    return out.otherwise(0.0)
