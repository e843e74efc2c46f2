"""Text rules over documents, pages, benchmark texts, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import questions as q
from tessera.plans.catalog import table
from tessera.plans.registry import Book
from tessera.plans.scoring_queries import _LABEL, _canonical, _normal

BOOK = Book()
#: White space of Unicode in DuckDB's pattern language.
_BLANKS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Documents some of which have other blanks than the plain one, and a bullet.
_ODD = "(SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN translate(text, ' ', chr(160)) WHEN 1 THEN '* ' || replace(text, ' ', chr(8195) || ' ') WHEN 2 THEN replace(text, 'a', 'a' || chr(12288)) ELSE text END AS text FROM documents) AS odd"


def _odd(spark, sf_dir):
    k, x = F.col("doc_id") % 4, F.col("text")
    text = F.when(k == 0, F.translate(x, " ", "\u00a0")).when(k == 1, F.concat(F.lit("* "), F.replace(x, F.lit(" "), F.lit("\u2003 ")))).when(k == 2, F.replace(x, F.lit("a"), F.lit("a\u3000"))).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


_TOKENS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+(?:[_-][A-Za-z0-9]+)*'), lambda x: lower(x))"


@BOOK.add(f"SELECT doc_id, {_canonical('text')} AS canonical, {_LABEL.replace('(z)', '(text)')} AS label, {_normal('text')} AS normal FROM documents")
def text_canonical(spark, sf_dir):
    """P3, P4, P5."""
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.canonical(x).alias("canonical"), t.canonical_label(x).alias("label"), t.normalize(x).alias("normal"))


def _strip(steps, x: str) -> str:
    for pattern, by in steps:
        new = "chr(10) || chr(10)" if by else "''"
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


@BOOK.add(f"SELECT page_id, {_strip(t.LOSSY_MARKUP, 'html')} AS lossy, {_strip(t.CAREFUL_MARKUP, 'html')} AS careful FROM pages")
def text_strip_markup(spark, sf_dir):
    """P6, P7."""
    return table(spark, sf_dir, "pages").select("page_id", t.strip_markup(F.col("html")).alias("lossy"), t.strip_markup_carefully(F.col("html")).alias("careful"))


@BOOK.add(f"""SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS tokens, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_BLANKS}]+')) AS INTEGER) AS n_blank_tokens, substr(text, 1, 200) || '...' AS preview FROM {_ODD}""")
def text_tokens(spark, sf_dir):
    """P8, P33, P36."""
    x = F.col("text")
    return _odd(spark, sf_dir).select("doc_id", F.array_join(t.tokens(x), " ").alias("tokens"), t.n_blank_tokens(x).alias("n_blank_tokens"), t.preview(x).alias("preview"))


_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '[{_BLANKS}]+', ' ', 'g'))"


def _stripped(x: str) -> str:
    return f"trim(regexp_replace({x}, '^[*-] ', ''), ' .;:,')"


_BARE = _stripped(_CLEAN)
_SENTENCE = _stripped(f"CASE WHEN regexp_extract({_CLEAN}, '^(.*?[.!?]) ', 1) = '' THEN {_CLEAN} ELSE regexp_extract({_CLEAN}, '^(.*?[.!?]) ', 1) END")


def _limited(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN rtrim(substr({x}, 1, {n - 3}), ' .;:,') || '...' ELSE {x} END"


@BOOK.add(rf"""SELECT doc_id, {_limited(_BARE, 120)} AS label,
CASE WHEN length({_CLEAN}) > 2200 THEN rtrim(substr({_CLEAN}, 1, 2197)) || '...' ELSE {_CLEAN} END AS body,
{_limited(_SENTENCE, 140)} AS sentence,
CASE WHEN trim(regexp_replace(lower(coalesce(source, '')), '[^a-zA-Z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(coalesce(source, '')), '[^a-zA-Z0-9]+', '-', 'g'), '-') END AS slug FROM {_ODD}""")
def text_labels(spark, sf_dir):
    """P13, P14, P15, P16, P17."""
    x = F.col("text")
    return _odd(spark, sf_dir).select("doc_id", t.clean_label(x).alias("label"), t.truncate(x).alias("body"), t.first_sentence(x).alias("sentence"), t.slugify(F.col("source")).alias("slug"))


_FORMS = """a AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN props || ' as asked' WHEN 3 THEN 'no ' || substr(props, 1, 3)
  WHEN 4 THEN props || ' ' || props WHEN 5 THEN replace(props, '"', chr(39)) WHEN 6 THEN props || ' trailing }' WHEN 7 THEN '[' || props || ']' ELSE ' {"labels": ["' || event_type || '", "b"], "k": 1} ' END AS answer FROM events)"""


@BOOK.add(f"""WITH {_FORMS}, b AS (SELECT event_id, answer, trim(regexp_replace(trim(answer), '^```json\\s*(\\{{.*\\}})\\s*```$', '\\1', 's')) AS whole, regexp_extract(answer, '(?s)\\{{.*\\}}') AS span FROM a),
c AS (SELECT event_id, CASE WHEN json_valid(whole) THEN CASE WHEN starts_with(whole, '{{') THEN whole END WHEN span <> '' AND json_valid(span) THEN span END AS o, json_valid(whole) AND starts_with(whole, '{{') AS s FROM b)
SELECT event_id, o IS NOT NULL AS extractable, s AS strict, CAST(json_extract(o, '$.k') AS INTEGER) AS k, coalesce(array_to_string(CAST(json_extract(o, '$.labels') AS VARCHAR[]), '|'), '') AS labels FROM c""")
def json_answers(spark, sf_dir):
    """An object bare, fenced, before prose, broken, twice, in single quotes, before a stray brace, in a list, with labels."""
    props, k = F.col("props"), F.col("event_id") % 9
    forms = [
        props, F.concat(F.lit("```json\n"), props, F.lit("\n```")), F.concat(props, F.lit(" as asked")), F.concat(F.lit("no "), F.substring(props, 1, 3)), F.concat(props, F.lit(" "), props),
        F.replace(props, F.lit('"'), F.lit("'")), F.concat(props, F.lit(" trailing }")), F.concat(F.lit("["), props, F.lit("]")), F.concat(F.lit(' {"labels": ["'), "event_type", F.lit('", "b"], "k": 1} ')),
    ]
    answer = F.element_at(F.array(*forms), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    rows = rows.select("event_id", t.json_object("answer").alias("object"), t.strict_json_object("answer").alias("strict"))
    return rows.select("event_id", F.col("object").isNotNull().alias("extractable"), F.col("strict").isNotNull().alias("strict"), F.get_json_object("object", "$.k").cast("int").alias("k"), F.array_join(t.json_labels(F.col("object")), "|").alias("labels"))


_KINDS = "['T1_entity','T2_dependency','T3_path','T4_aggregate','T5_cross_concept'][1 + CAST(o_orderkey % 5 AS INT)]"


@BOOK.add(f"""WITH a AS (SELECT o_orderkey AS id, {_KINDS} AS type, 'Order ' || o_orderkey AS x, 'Clerk ' || o_custkey AS y FROM orders),
b AS (SELECT *, CASE type WHEN 'T1_entity' THEN 'What is ' || x || '?' WHEN 'T2_dependency' THEN 'What are the prerequisites for ' || x || '?' WHEN 'T3_path' THEN 'What is the prerequisite chain from ' || x || ' to ' || y || '?'
  WHEN 'T4_aggregate' THEN 'List all SPON concepts in this knowledge graph' ELSE CASE WHEN id % 2 = 0 THEN 'How does ' || x || ' relate to ' || y || '?' ELSE 'Explain the relationship between ' || x || ' and ' || y || '?' END END AS query FROM a)
SELECT id, type, query, CASE WHEN type = 'T4_aggregate' THEN 'SPON' ELSE x END AS first, CASE WHEN type IN ('T3_path', 'T5_cross_concept') THEN y ELSE '' END AS second,
CASE type WHEN 'T1_entity' THEN 'What taxonomy type is ' || x || '?' WHEN 'T2_dependency' THEN 'In the benchmark knowledge structure, what are the direct prerequisites for ' || x || '?'
  WHEN 'T5_cross_concept' THEN query ELSE 'In the benchmark knowledge structure, ' || lower(substr(query, 1, 1)) || substr(query, 2) END AS clarified FROM b""")
def question_texts(spark, sf_dir):
    """P1, P23, P24, P2."""
    kinds = F.array(*[F.lit(k) for k in q.ASKS])
    x, y = F.concat(F.lit("Order "), F.col("o_orderkey")), F.concat(F.lit("Clerk "), F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("type"), x.alias("x"), y.alias("y"))
    five = F.when(F.col("id") % 2 == 0, F.concat(F.lit("How does "), "x", F.lit(" relate to "), "y", F.lit("?"))).otherwise(F.concat(F.lit("Explain the relationship between "), "x", F.lit(" and "), "y", F.lit("?")))
    text = (
        F.when(F.col("type") == "T1_entity", F.concat(F.lit("What is "), "x", F.lit("?")))
        .when(F.col("type") == "T2_dependency", F.concat(F.lit("What are the prerequisites for "), "x", F.lit("?")))
        .when(F.col("type") == "T3_path", F.concat(F.lit("What is the prerequisite chain from "), "x", F.lit(" to "), "y", F.lit("?")))
        .when(F.col("type") == "T4_aggregate", F.lit("List all SPON concepts in this knowledge graph"))
        .otherwise(five)
    )
    rows = rows.withColumn("query", text)
    return rows.join(q.parsed(rows).drop("type"), "id").select("id", "type", "query", "first", "second", q.clarified(F.col("type"), F.col("query"), F.col("x")).alias("clarified"))


@BOOK.add(f"""SELECT event_id, ['AREA','AREA','COND','COND','INTR','END POINT','OUTC','SPON','PHASE','STATUS','TRIAL','SOMETHING ELSE'][1 + CAST(event_id % 12 AS INT)] AS code,
CASE WHEN event_id % 2 = 0 THEN 'Represent: ' || event_type ELSE event_type END AS dense_query, round(event_id % 1000 * 1e-6::DOUBLE + event_id % 77 * 5e-6::DOUBLE, 8) AS cost FROM events""")
def text_codes(spark, sf_dir):
    """P10, P28, P34."""
    names = ("area", "Landscape", "condition", "DISEASE", "treatment", "end-point", "Measure", "sponsor!", "trial phase", "Recruitment status", "study", "Something else")
    k = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (k % 12 + 1).cast("int"))
    model = F.when(k % 2 == 0, "BAAI/bge-small").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", t.taxonomy_value(name).alias("code"), t.dense_query(F.col("event_type"), model, "Represent: ").alias("dense_query"), t.cost(k % 1000, k % 77).alias("cost"))
