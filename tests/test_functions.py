"""Text rules and scores on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("rule", "given", "expected"),
    [
        (t.canonical, "  Béta-Carotène, (depends_on)! ", "béta carotène depends_on"),
        (t.canonical, None, None),
        (t.canonical_label, "see nct01234567: A Trial", "nct01234567"),
        (t.canonical_label, "A Trial.", "a trial"),
        (t.normalize, "## **Bold**_it_ `x`", "bold it x"),
        (t.strip_markup, "a <b>c</b> <26 and > 4 https://x.y/z", "a c  4"),
        (t.strip_markup_carefully, "age <26 and value > 4 <!-- c --> [s](https://a.b)", "age <26 and value > 4  [s]()"),
        (t.taxonomy_value, "Disease!", "COND"),
        (t.taxonomy_value, "phase", "PHASE"),
        (t.taxonomy_value, "other thing", "OTHER THING"),
        (t.clean_label, "* label ;:", "label"),
        (t.clean_label, "x" * 130, "x" * 117 + "..."),
        (t.slugify, "A b/C", "a-b-c"),
        (t.slugify, "!!", "item"),
        (t.first_sentence, "One. Two. Three", "One"),
        (t.first_sentence, "z" * 150 + "! b", "z" * 137 + "..."),
        (t.clean_text, "a\u00a0\u2003b\u3000", "a b"),
        (t.n_blank_tokens, "a\u00a0b", 2),
        (t.clean_label, "x" * 116 + " ; yyyy", "x" * 116 + "..."),
        (t.first_sentence, "no stop", "no stop"),
        (t.truncate, "y" * 2300, "y" * 2197 + "..."),
        (t.n_blank_tokens, " a\n b  c ", 3),
        (t.n_blank_tokens, None, 0),
        (t.json_object, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (t.json_object, 'sure: {"a": 1} done', '{"a": 1}'),
        (t.json_object, "none", None),
        (t.json_object, '{"a": 1} {"b": 2}', None),
        (t.json_object, "{'a': 1}", None),
        (t.json_object, '[{"a": 1}]', None),
        (t.strict_json_object, '{"a": 1} trailing }', None),
        (t.strict_json_object, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (t.strict_json_object, '{"a": 1} done', None),
    ],
)
def test_text_rule(spark, rule, given, expected):
    assert one(spark, rule(F.lit(given).cast("string"))) == expected


def test_tokens_and_ids(spark):
    assert one(spark, t.tokens(F.lit("Alpha-Beta x_y é1 --"))) == ["alpha-beta", "x_y", "1"]
    assert one(spark, t.tokens(F.lit(None).cast("string"))) == []
    assert one(spark, t.registry_ids(F.lit("nct00000002 NCT00000001"), F.lit("NCT00000002 NCT1"))) == ["NCT00000001", "NCT00000002"]
    assert one(spark, t.json_labels(F.lit('{"labels": ["a", 1, true]}'))) == ["a", "1", "true"]
    assert one(spark, t.json_labels(F.lit('{"labels": 3}'))) == []


def test_terms_in_context(spark):
    assert not one(spark, s.category_coverage(F.lit("intraoperative administration"), F.lit("INTR")))
    assert one(spark, s.category_coverage(F.lit("an intervention was described"), F.lit("INTR"))) == 1.0
    assert one(spark, t.holds_term(F.lit("x alpha beta y"), F.lit("Alpha, beta")))
    assert not one(spark, t.holds_term(F.lit("alphabet"), F.lit("alpha")))
    assert one(spark, t.holds_substring(F.lit("alphabet"), F.lit("alpha")))
    assert one(spark, s.coverage(F.lit("a b c"), F.array(F.lit("b"), F.lit("z")))) == 0.5


def arrays(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize(
    ("predicted", "expected", "f1", "exact"),
    [(["NCT01234567"], ["NCT01234567 A Long Title"], 1.0, True), (["a", "b"], ["a"], 0.666667, False), ([], ["a"], 0.0, False), ([], [], 1.0, True), (["x"], [], 0.0, False), (["A!", "a"], ["a"], 1.0, True)],
)
def test_set_f1(spark, predicted, expected, f1, exact):
    got = one(spark, s.set_f1(arrays(*predicted), arrays(*expected)))
    assert (got["f1"], got["exact"]) == (f1, exact)


@pytest.mark.parametrize(("given", "f1"), [(["a", "b", "c"], 1.0), (["a", "c"], 0.0), (["c", "b", "a"], 0.0), ([], 0.0), (["a"], 0.0)])
def test_edge_f1(spark, given, f1):
    assert one(spark, s.edge_f1(arrays(*given), arrays("a", "b", "c")))["f1"] == f1
    assert one(spark, s.edge_f1(arrays(*given), arrays("a")))["f1"] == 0.0


@pytest.mark.parametrize(("a", "b", "f1"), [("", "", 1.0), ("word", "", 0.0), ("the alpha beta", "alpha of gamma", 0.5), ("What is the", "", 1.0)])
def test_token_f1(spark, a, b, f1):
    assert one(spark, s.token_f1(F.lit(a), F.lit(b))) == f1


def test_relation_score(spark):
    def score(kind, truth, labels=(), source=None, relation=None, target=None, **kw):
        r = F.struct(F.lit(source).alias("source"), F.lit(relation).alias("relation"), F.lit(target).alias("target"))
        return one(spark, s.relation_score(F.lit(kind), arrays(*truth), arrays(*labels), r, **kw))["f1"]

    assert score("T1_entity", ["X", "INTR"], ["treatment"]) == 1.0
    assert score("T1_entity", ["X", "INTR"], ["intervention", "other"]) == 0.666667
    assert score("T1_entity", ["X", "INTR"], ["intervention", "other"], first_label_only=True) == 1.0
    assert score("T2_dependency", ["a"], ["a"]) == 1.0
    assert score("T3_path", ["c", "b", "a"], ["a", "b", "c"]) == 1.0
    assert score("T3_path", ["c", "b", "a"], ["c", "b", "a"]) == 0.0
    assert score("T5_cross_concept", ["a", "b"], (), "a", "depends on", "b") == 1.0
    assert score("T5_cross_concept", ["a", "b"], (), "b", "depends on", "a") == 0.0
    assert score("T5_cross_concept", ["a", "b"], (), "a", "unknown", "b") == 0.0
    with pytest.raises(Exception, match="unknown question type"):
        score("T9", ["a"])
