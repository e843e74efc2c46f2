"""Scores, roll-ups and comparisons over conversations, documents and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring as s
from tessera.functions import text as t
from tessera.operators import answering, rollup
from tessera.plans.catalog import table
from tessera.plans.registry import Book
from tessera.storage import joined_by

BOOK = Book()
_NOT_WORD = r"[^\p{L}\p{N}_\s]"


def _canonical(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '{_NOT_WORD}', ' ', 'g'), '\s+', ' ', 'g'))"


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[*_`]+', ' ', 'g'), '#+\s*', ' ', 'g'), '{_NOT_WORD}', ' ', 'g'), '\s+', ' ', 'g'))"


def _words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in ("", *s.STOP_WORDS))
    return f"list_filter(list_distinct(string_split({_normal(x)}, ' ')), lambda w: w NOT IN ({stop}))"


@BOOK.add(f"""WITH p AS (SELECT u.conv_id, u.turn, coalesce(u.text, '') AS u, coalesce(a.text, '') AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
w AS (SELECT conv_id, turn, {_words('u')} AS x, {_words('a')} AS p FROM p),
k AS (SELECT conv_id, turn, len(x) AS nx, len(p) AS np, len(list_intersect(x, p)) AS k FROM w)
SELECT conv_id, turn, CASE WHEN nx = 0 AND np = 0 THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (nx + np), 4) END AS token_f1 FROM k""")
def score_token_f1(spark, sf_dir):
    """An answer's words against its question's."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    answer = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return asked.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", s.token_f1(F.col("a"), F.col("u")).alias("token_f1"))


# label lists for the set and edge scores, from the lines of an order
_LISTS = """i AS (SELECT l_orderkey AS id, l_linenumber AS k, CASE l_linenumber % 4 WHEN 0 THEN 'NCT' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || ' x' WHEN 1 THEN 'Part ' || l_partkey ELSE 'Supp. ' || (l_suppkey % 7) END AS x FROM lineitem),
b AS (SELECT id, list(x ORDER BY k, x) AS x FROM i GROUP BY 1),
y AS (SELECT id, x, CASE id % 3 WHEN 0 THEN list_reverse(x) WHEN 1 THEN x[2:] ELSE list_transform(x, lambda z: upper(z)) END AS p FROM b)"""
_LABEL = r"CASE WHEN regexp_extract(upper(z), '\bNCT\d{8}\b') <> '' THEN lower(regexp_extract(upper(z), '\bNCT\d{8}\b')) ELSE " + _canonical("z") + " END"


def _lists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    k = F.col("l_linenumber") % 4
    label = F.when(k == 0, F.concat(F.lit("NCT"), F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.lit(" x"))).when(k == 1, F.concat(F.lit("Part "), F.col("l_partkey"))).otherwise(F.concat(F.lit("Supp. "), F.col("l_suppkey") % 7))
    b = items.select(F.col("l_orderkey").alias("id"), "l_linenumber", label.alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))), lambda z: z["x"]).alias("x"))
    p = F.when(F.col("id") % 3 == 0, F.reverse("x")).when(F.col("id") % 3 == 1, F.slice("x", 2, 100)).otherwise(F.transform("x", F.upper))
    return b.withColumn("p", p)


@BOOK.add(f"""WITH {_LISTS}, d AS (SELECT id, list_filter(list_distinct(list_transform(x, lambda z: {_LABEL})), lambda w: w <> '') AS x, list_filter(list_distinct(list_transform(p, lambda z: {_LABEL})), lambda w: w <> '') AS p FROM y),
k AS (SELECT id, len(x) AS nx, len(p) AS np, len(list_intersect(x, p)) AS k FROM d)
SELECT id, CASE WHEN np = 0 THEN 0.0::DOUBLE ELSE round(k / np::DOUBLE, 6) END AS precision, round(k / nx::DOUBLE, 6) AS recall, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (nx + np), 6) END AS f1, k = nx AND k = np AS exact FROM k""")
def score_set_f1(spark, sf_dir):
    """Label lists as sets."""
    score = s.set_f1(F.col("p"), F.col("x"))
    return _lists(spark, sf_dir).select("id", score.alias("s")).select("id", "s.*")


@BOOK.add(f"""WITH {_LISTS}, d AS (SELECT id, list_transform(x, lambda z: {_LABEL}) AS x, list_transform(p, lambda z: {_LABEL}) AS p FROM y),
g AS (SELECT id, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || chr(1) || x[i + 1])) AS x, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || chr(1) || p[i + 1])) AS p FROM d),
k AS (SELECT id, len(x) AS nx, len(p) AS np, len(list_intersect(x, p)) AS k FROM g)
SELECT id, CASE WHEN nx = 0 OR k = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (nx + np), 6) END AS f1, nx > 0 AND k = nx AND k = np AS exact FROM k""")
def score_edge_f1(spark, sf_dir):
    """Directed consecutive pairs."""
    score = s.edge_f1(F.col("p"), F.col("x"))
    return _lists(spark, sf_dir).select("id", score.alias("s")).select("id", "s.f1", "s.exact")


_TYPES = "['T1_entity','T2_dependency','T3_path','T4_aggregate','T5_cross_concept'][1 + CAST(id % 5 AS INT)]"


@BOOK.add(f"""WITH {_LISTS}, q AS (SELECT id, {_TYPES} AS type, x, p FROM y),
c AS (SELECT id, type, list_transform(x, lambda z: {_LABEL}) AS x, list_transform(p, lambda z: {_LABEL}) AS p, list_reverse(list_transform(x, lambda z: {_LABEL})) AS rx,
  list_distinct(list_transform(p, lambda z: upper({_canonical("z")}))) AS codes, upper({_canonical("x[-1]")}) AS code FROM q),
k AS (SELECT id, type, list_distinct(x) AS sx, list_distinct(p) AS sp, codes, code, x, p, list_distinct(list_transform(range(1, len(rx)), lambda i: rx[i] || chr(1) || rx[i + 1])) AS ex, list_distinct(list_transform(range(1, len(p)), lambda i: p[i] || chr(1) || p[i + 1])) AS ep FROM c),
m AS (SELECT id, type, CASE type WHEN 'T1_entity' THEN len(list_intersect(codes, [code])) WHEN 'T3_path' THEN len(list_intersect(ex, ep)) ELSE len(list_intersect(sx, sp)) END AS k,
  CASE type WHEN 'T1_entity' THEN 1 + len(codes) WHEN 'T3_path' THEN len(ex) + len(ep) ELSE len(sx) + len(sp) END AS n, len(p) > 0 AND coalesce(x[1] = p[1] AND x[-1] = p[-1], false) AS hit FROM k)
SELECT id, type, CASE WHEN type = 'T5_cross_concept' THEN CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN k = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / n, 6) END AS f1 FROM m""")
def score_by_type(spark, sf_dir):
    """The score that the question type asks for."""
    kinds = F.array(*[F.lit(x) for x in ("T1_entity", "T2_dependency", "T3_path", "T4_aggregate", "T5_cross_concept")])
    rows = _lists(spark, sf_dir).withColumn("type", F.element_at(kinds, (F.col("id") % 5 + 1).cast("int")))
    relation = F.struct(F.get("p", F.lit(0)).alias("source"), F.lit("depends on").alias("relation"), F.get("p", F.size("p") - 1).alias("target"))
    score = s.relation_score(F.col("type"), F.col("x"), F.col("p"), relation)
    return rows.select("id", "type", score["f1"].alias("f1"))


@BOOK.add(f"""WITH d AS (SELECT doc_id, ' ' || {_canonical("coalesce(text, '')")} || ' ' AS c FROM documents), b AS (SELECT {_canonical("text")} AS t, item_id FROM benchmark),
h AS (SELECT doc_id, count(*) AS k FROM d, b WHERE t <> '' AND contains(c, ' ' || t || ' ') GROUP BY 1)
SELECT doc_id, round(coalesce(k, 0) / (SELECT count(*) FROM benchmark)::DOUBLE, 6) AS coverage FROM d LEFT JOIN h USING (doc_id)""")
def score_coverage(spark, sf_dir):
    """The share of benchmark texts that a document holds, by shared five-word runs and then exactly."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("c"))
    items = table(spark, sf_dir, "benchmark").select("item_id", t.canonical(F.col("text")).alias("t")).where("t <> ''")
    held = _held(docs, items).groupBy("doc_id").agg(F.count("*").alias("k"))
    total = items.sparkSession.createDataFrame([(table(spark, sf_dir, "benchmark").count(),)], "total long")
    out = docs.select("doc_id").join(held, "doc_id", "left").crossJoin(F.broadcast(total))
    return out.select("doc_id", F.round(F.coalesce("k", F.lit(0)) / F.col("total"), 6).alias("coverage"))


#: Slots that the items' runs fall into, however many items there are.
SLOTS = 1 << 20


def _held(docs, items):
    """doc_id, item_id: the items (item_id, t), canonical, whose words each text (doc_id, c) holds in a row.

    A held text's first five words (all, if it has fewer) stand in the document,
    so an equi-join on word runs finds every place to test.  Places whose run
    cannot be an item's fall out at a table of slots, inside the loop over the
    text's words and in compiled code; only the others take the words that
    follow with them.  A place is tested by those words, not by the whole text.
    """
    # what a shorter run lacks is null, which the hash passes over
    run = lambda at: f"xxhash64(n, {', '.join(f'IF(n > {j}, get(w, {at} + {j}), NULL)' for j in range(5))})"
    slot = f"run & {SLOTS - 1}"
    keyed = items.withColumn("w", F.split("t", " ")).withColumn("n", F.least(F.size("w"), F.lit(5)))
    keyed = keyed.select("item_id", "t", "n", F.size("w").alias("long"), F.expr(run(0)).alias("run"), F.monotonically_increasing_id().alias("item"))
    keyed = joined_by(keyed, "items")
    sizes = {r["n"]: r["long"] for r in keyed.groupBy("n").agg(F.max("long").alias("long")).collect()}  # at most five
    if not sizes:
        return docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    slots = keyed.select(F.expr(slot).alias("slot")).distinct()  # at most SLOTS
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", t.canonical_words(F.col("c")).alias("w"))
    texts = texts.select("row", "doc_id", "w", F.explode(F.expr(f"filter(array({', '.join(map(str, sorted(sizes)))}), n -> n <= size(w))")).alias("n"))
    places = texts.select("*", F.explode(F.expr("sequence(0, size(w) - n)")).alias("i")).withColumn("run", F.expr(run("i")))
    places = places.join(F.broadcast(slots), F.expr(slot) == F.col("slot"), "left_semi")
    tail = F.array_join(F.slice("w", F.col("i") + 1, F.when(F.col("n") < 5, F.col("n")).otherwise(max(sizes.values()))), " ")
    places = places.select("row", "doc_id", "run", tail.alias("tail"))
    starts = F.startswith(F.concat("tail", F.lit(" ")), F.concat("t", F.lit(" ")))
    return places.join(keyed.drop("n", "long"), "run").where(starts).select("row", "item", "doc_id", "item_id").distinct().select("doc_id", "item_id")


_ROWS = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'graph' ELSE 'passages' END AS system, o_orderpriority AS type, o_orderstatus AS domain,
  (o_orderkey % 101) / 100.0::DOUBLE AS f1, o_orderkey % 101 = 100 AS exact, (o_orderkey % 11) / 10.0::DOUBLE AS coverage, (o_orderkey % 13) / 12.0::DOUBLE AS token_f1,
  o_orderkey % 7 <> 0 AS extractable, o_orderkey % 5 <> 0 AS strict, o_orderkey % 1000 AS prompt, o_orderkey % 90 AS completion FROM orders),
a AS (SELECT *, prompt + completion AS total_tokens, round(prompt * 1e-6::DOUBLE + completion * 5e-6::DOUBLE, 8) AS cost FROM r)"""


def _rows(spark, sf_dir):
    k = F.col("id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("domain"))
    rows = rows.withColumns({"system": F.when(k % 2 == 0, "graph").otherwise("passages"), "f1": (k % 101) / 100.0, "exact": k % 101 == 100, "coverage": (k % 11) / 10.0, "token_f1": (k % 13) / 12.0, "extractable": k % 7 != 0, "strict": k % 5 != 0, "prompt": k % 1000, "completion": k % 90})
    return rows.withColumns({"total_tokens": F.col("prompt") + F.col("completion"), "cost": t.cost(F.col("prompt"), F.col("completion"))})


@BOOK.add(f"""WITH {_ROWS} SELECT system, type, domain, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(exact::INT::DOUBLE), 6) AS mean_exact, round(avg(coverage), 6) AS mean_coverage,
round(avg(token_f1), 6) AS mean_token_f1, round(avg(extractable::INT::DOUBLE), 6) AS mean_extractable, round(avg(strict::INT::DOUBLE), 6) AS mean_strict, round(avg(total_tokens), 3) AS mean_tokens, round(sum(cost), 6) AS total_cost
FROM a GROUP BY GROUPING SETS ((system), (system, type), (system, domain))""")
def rollup_summary(spark, sf_dir):
    """A1, A4, P34."""
    return rollup.summary(_rows(spark, sf_dir))


@BOOK.add(f"""WITH {_ROWS}, b AS (SELECT *, id % 4 AS hop, CASE WHEN total_tokens > 0 THEN round(f1 / total_tokens, 8) ELSE 0 END AS rds FROM a)
SELECT system, type, hop, count(*) AS n, round(avg(f1), 4) AS macro_f1, round(avg(rds) FILTER (rds > 0), 8) AS macro_rds, round(avg(total_tokens), 1) AS mean_tokens, round(sum(cost), 4) AS total_cost
FROM b GROUP BY GROUPING SETS ((system), (system, type), (system, hop))""")
def rollup_older_summary(spark, sf_dir):
    """A2, A3, A5, P35."""
    rows = _rows(spark, sf_dir).withColumns({"hop": F.col("id") % 4, "rds": t.yield_per_token(F.col("f1"), F.col("total_tokens"))})
    return rollup.older_summary(rows)


_SYSTEM = "['graph','passages','router'][1 + CAST(id % 3 AS INT)]"


@BOOK.add(f"""WITH {_ROWS}, s AS (SELECT {_SYSTEM} AS system, CASE WHEN id % 4 = 0 THEN NULL ELSE cost END AS spent FROM a)
SELECT system, round(coalesce(sum(spent), 0), 6) AS new_api_spend_usd FROM s GROUP BY 1
UNION ALL SELECT NULL, round(coalesce(sum(spent) FILTER (system <> 'router'), 0), 6) FROM s""")
def rollup_new_spend(spark, sf_dir):
    """A4: what a run spent anew, the router left out of the total."""
    kinds = F.array(*[F.lit(x) for x in ("graph", "passages", "router")])
    rows = _rows(spark, sf_dir).withColumns({"system": F.element_at(kinds, (F.col("id") % 3 + 1).cast("int")), "new_api_spend_usd": F.when(F.col("id") % 4 != 0, F.col("cost"))})
    return rollup.new_spend(rows)


@BOOK.add(f"""WITH {_ROWS} SELECT count(*) AS n, round(avg(f1), 6) AS macro_f1, round(avg(prompt + completion), 3) AS mean_tokens,
round(sum(prompt) * 1e-6::DOUBLE + sum(completion) * 5e-6::DOUBLE, 6) AS cost FROM a""")
def rollup_recomputed(spark, sf_dir):
    """A5: totals with the cost told anew from the tokens."""
    return rollup.recomputed(_rows(spark, sf_dir).withColumnsRenamed({"prompt": "prompt_tokens", "completion": "completion_tokens"}))


@BOOK.add("""SELECT o_orderkey AS id, 'ckg' AS system, o_orderpriority AS type, '4' AS harness_version, 'new' AS run_id, '3' AS source_harness_version, 'r' || o_orderkey % 5 AS source_run_id,
'reused_integrity_v3_annotation_blind_ckg' AS retrieval_mode, 'reused_integrity_v3_raw_output' AS generation_status, 0.0::DOUBLE AS new_api_spend_usd,
sha256('{"harness_version":"3","id":' || o_orderkey || ',"run_id":"r' || o_orderkey % 5 || '","system":"graph","type":"' || o_orderpriority || '"}') AS source_row_sha256 FROM orders""")
def reused_rows(spark, sf_dir):
    """Rows of an earlier run with their provenance."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("graph").alias("system"), F.col("o_orderpriority").alias("type"), F.lit("3").alias("harness_version"), F.concat(F.lit("r"), (F.col("o_orderkey") % 5).cast("string")).alias("run_id"))
    return answering.reused(rows, "4", "new")


def _sides(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    side = lambda m, q: rows.withColumns({"value": (F.col("id") % m) / float(m), "tokens": F.col("id") % q, "cost": (F.col("id") % q) / 1000.0})
    return side(7, 50), side(5, 80)


_SIDES = "x AS (SELECT o_orderkey AS id, (o_orderkey % 7) / 7.0::DOUBLE AS l, (o_orderkey % 5) / 5.0::DOUBLE AS r, o_orderkey % 50 AS lt, o_orderkey % 80 AS rt FROM orders)"


@BOOK.add(f"WITH {_SIDES} SELECT count(*) FILTER (l > r) AS wins, count(*) FILTER (l < r) AS losses, count(*) FILTER (l = r) AS ties, count(*) AS n FROM x")
def compare_win_loss_tie(spark, sf_dir):
    """A6, J9."""
    return rollup.win_loss_tie(*_sides(spark, sf_dir))


@BOOK.add(f"""WITH {_SIDES} SELECT round(avg(l) / avg(r), 6) AS f1_ratio, round(avg(l) - avg(r), 6) AS absolute_lift, round(1 - avg(lt) / avg(rt), 6) AS token_reduction,
round(1 - sum(lt / 1000.0::DOUBLE) / sum(rt / 1000.0::DOUBLE), 6) AS cost_reduction, round(count(*) FILTER (l > r) / count(*)::DOUBLE, 6) AS win_rate FROM x""")
def compare_ratios(spark, sf_dir):
    """A7."""
    return rollup.paired_ratios(*_sides(spark, sf_dir))


@BOOK.add("""WITH m AS (SELECT o_orderpriority AS type, ['base', 'graph', 'frontier'][1 + CAST(o_orderkey % 3 AS INT)] AS mode, (o_orderkey % 17) / 16.0::DOUBLE AS f1 FROM orders),
g AS (SELECT type, avg(f1) FILTER (mode = 'base') AS b, avg(f1) FILTER (mode = 'graph') AS g, avg(f1) FILTER (mode = 'frontier') AS f FROM m GROUP BY 1)
SELECT type, round(CASE WHEN f = b THEN 0 ELSE (g - b) / (f - b) END, 4) AS gap_closed FROM g""")
def compare_gap_closed(spark, sf_dir):
    """A8."""
    modes = F.array(F.lit("base"), F.lit("graph"), F.lit("frontier"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.element_at(modes, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("mode"), ((F.col("o_orderkey") % 17) / 16.0).alias("f1"))
    return rollup.gap_closed(rows, ["type"]).withColumn("gap_closed", F.round("gap_closed", 4))
