"""URL filter by the ratio of two character language models, with built-in functions only.

Rules decide the URLs they fit; the longest rule wins.  The URLs that rules
allow and block are the accepted and rejected examples from which two
variable-order Markov models are learned: the chance of a character given up
to ORDER characters before it, smoothed at every order towards the next lower
one in proportion to how often new characters followed (Witten and Bell).  A
URL without a rule is judged by the difference of its log-likelihoods under
the models per character, against a threshold calibrated on examples that the
models have not learned from (those whose MD5 begins with 0 to 3, a quarter): the
point at equal numbers of standard deviations from both class means.

The counts come from all URLs.  Each character gives one row (gram); counting
combines before the shuffle, and the models are tables of the distinct grams,
joined level by level.  Nothing of the models is collected or broadcast: they
grow with the corpus, so their joins are merge joins at every size, and grams
that nearly every URL holds are skew that adaptive joins split.

Defined results: a null URL or one without ``://`` has empty host and path, no
rule, and is judged like any text, by its end mark alone; where either class
has no example apart from those learned from, all examples calibrate; where it
has none at all, every URL without a rule is allowed; very long URLs give a row
a character; equal scores and
thresholds allow; repeated rows each get a result and each count as an
example; an empty table gives an empty result; only the id and the URL are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

ORDER = 4
#: Characters before the first and after the last one of a URL.
PAD, END = "\x02", "\x03"
#: The chance of a character that no order knows.
FLOOR = 1 / 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First digits of the MD5 of the examples that calibrate.
HELD_OUT = ("0", "1", "2", "3")
#: (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.coalesce(rest, F.lit("")), F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _fitting(rules: Sequence[tuple[str, str]], value) -> Column:
    """``value`` of the longest rule that fits ``_host`` and ``_path``, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("_host") == host) | F.endswith("_host", F.lit("." + host))) & F.startswith("_path", F.lit(slash + path))
        out = F.when(fits, value(verdict, rule)) if out is None else out.when(fits, value(verdict, rule))
    return F.lit(None).cast("string") if out is None else out


def model(grams: DataFrame) -> DataFrame:
    """(gram, a, b): log-probability of the last character of each gram under both models.

    ``grams``: gram of ORDER + 1 characters, na and nb, its counts in the classes.
    """
    below = None
    for k in range(ORDER + 1):
        part = F.substr("gram", F.lit(ORDER + 1 - k))
        level = grams.groupBy(part.alias("g")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).withColumn("ctx", F.substr("g", F.lit(1), F.lit(k)))
        sums = [F.sum("na").alias("ca"), F.sum("nb").alias("cb"), F.count_if(F.col("na") > 0).alias("ta"), F.count_if(F.col("nb") > 0).alias("tb")]
        seen = level.groupBy("ctx").agg(*sums)
        if below is None:
            level = level.join(F.broadcast(seen.limit(1)), "ctx").withColumns({"pa": F.lit(FLOOR), "pb": F.lit(FLOOR)})  # one row: the empty context
        else:
            level = level.join(seen.hint("merge"), "ctx").withColumn("low", F.substr("g", F.lit(2))).join(below.hint("merge"), "low")
        mix = lambda n, c, t, p: F.when(F.col(c) == 0, F.col(p)).otherwise((F.col(n) + F.col(t) * F.col(p)) / (F.col(c) + F.col(t)))
        level = level.select("g", mix("na", "ca", "ta", "pa").alias("pa"), mix("nb", "cb", "tb", "pb").alias("pb"))
        below = level.withColumnRenamed("g", "low")
    return below.select(F.col("low").alias("gram"), F.ln("pa").alias("a"), F.ln("pb").alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of every row."""
    host, path = parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumns({"_host": host, "_path": path})
    rows = rows.select("_id", "_host", "_path", _fitting(rules, lambda v, r: F.lit(r)).alias("_rule"), _fitting(rules, lambda v, r: F.lit(v)).alias("_verdict"))
    # equal host and path give equal results, so the models see each once, with its number
    held = F.substring(F.md5(F.concat("_host", "_path")), 1, 1).isin(*HELD_OUT).alias("_held")
    texts = stored(rows.groupBy("_host", "_path", "_rule", "_verdict").agg(F.count("*").alias("_n")).select("*", held), "urls")
    # a row becomes one for each of its characters, so rows are spread over tasks first
    spread = texts.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, texts.count() // 50_000 + 1))
    padded = F.concat(F.lit(PAD * ORDER), "_host", "_path", F.lit(END))
    each = spread.withColumns({"_all": padded, "_len": F.length(F.concat("_host", "_path")) + 1})
    spots = each.select("_host", "_path", "_verdict", "_held", "_n", "_len", F.col("_all"), F.explode(F.sequence(F.lit(1), F.col("_len"))).alias("_i")).select("_host", "_path", "_verdict", "_held", "_n", "_len", F.substr("_all", F.col("_i"), F.lit(ORDER + 1)).alias("gram"))
    of = lambda v: F.sum(F.when((F.col("_verdict") == v) & ~F.col("_held"), F.col("_n")).otherwise(0))
    counts = stored(spots.groupBy("gram").agg(of("allow").alias("na"), of("block").alias("nb")), "grams")
    learned = model(counts).select("gram", (F.col("a") - F.col("b")).alias("d"))
    scores = stored(spots.select("_host", "_path", "_len", "gram").join(learned.hint("merge"), "gram").groupBy("_host", "_path").agg((F.sum("d") / F.first("_len")).alias("score")), "scores")
    known = texts.where("_verdict is not null").join(scores.hint("merge"), ["_host", "_path"])
    sums = [F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("score")).alias("s"), F.sum(F.col("_n") * F.col("score") * F.col("score")).alias("q")]
    threshold = calibrated([tuple(r) for r in known.groupBy("_verdict", "_held").agg(*sums).collect()])
    out = rows.join(scores.hint("merge"), ["_host", "_path"], "left")
    by_model = F.lit("allow") if threshold is None else F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", by_model).alias("verdict"), "score")


def calibrated(sums: Sequence[tuple]) -> float | None:
    """The threshold from (verdict, held out, number, sum and sum of squares of scores) of the examples."""
    fresh = [x for x in sums if x[1]]
    if {x[0] for x in fresh} != {"allow", "block"}:
        fresh = list(sums)
    at = []
    for verdict in ("allow", "block"):
        n, s, q = (sum(x[i] for x in fresh if x[0] == verdict) for i in (2, 3, 4))
        if not n:
            return None
        at.append((s / n, max(q / n - (s / n) ** 2, 0.0) ** 0.5))
    (ma, sa), (mb, sb) = at
    return (ma + mb) / 2 if sa + sb == 0 else (ma * sb + mb * sa) / (sa + sb)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    lines = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        lines.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in lines) + " END"
    levels = ""
    for k in range(ORDER + 1):
        mix = lambda c, k=k: f"CASE WHEN c{c} = 0 THEN p{c} ELSE (n{c} + t{c} * p{c}) / (c{c} + t{c}) END AS p{c}"
        low = f"JOIN p{k - 1} ON substr(l.g, 2) = p{k - 1}.g" if k else ""
        start = "" if k else f", CAST({FLOOR} AS DOUBLE) AS pa, CAST({FLOOR} AS DOUBLE) AS pb"
        levels += f"""
l{k} AS (SELECT substr(gram, {ORDER + 1 - k}) AS g, sum(na) AS na, sum(nb) AS nb FROM c GROUP BY 1),
s{k} AS (SELECT substr(g, 1, {k}) AS ctx, sum(na) AS ca, sum(nb) AS cb, count(*) FILTER (na > 0) AS ta, count(*) FILTER (nb > 0) AS tb FROM l{k} GROUP BY 1),
p{k} AS (SELECT g, {mix("a")}, {mix("b")} FROM (SELECT l.g, na, nb, ca, cb, ta, tb{start or ", pa, pb"} FROM l{k} l JOIN s{k} s ON substr(l.g, 1, {k}) = s.ctx {low})),"""
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
r0 AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, {case(1)} AS rule, {case(2)} AS known, substr(md5(host || path), 1, 1) IN {HELD_OUT} AS held, row_number() OVER () AS rid FROM r0),
t AS (SELECT rid, known, held, repeat(chr(2), {ORDER}) || host || path || chr(3) AS x, length(host || path) + 1 AS n FROM r),
i AS (SELECT rid, known, held, x, n, unnest(range(1, n + 1)) AS i FROM t),
g AS (SELECT rid, known, held, n, substr(x, i, {ORDER + 1}) AS gram FROM i),
c AS (SELECT gram, CAST(count(*) FILTER (known = 'allow' AND NOT held) AS DOUBLE) AS na, CAST(count(*) FILTER (known = 'block' AND NOT held) AS DOUBLE) AS nb FROM g GROUP BY 1),{levels}
q AS (SELECT rid, any_value(known) AS known, any_value(held) AS held, sum(ln(pa) - ln(pb)) / any_value(n) AS score FROM g JOIN p{ORDER} ON gram = p{ORDER}.g GROUP BY rid),
o AS (SELECT count(*) FILTER (known = 'allow' AND held) > 0 AND count(*) FILTER (known = 'block' AND held) > 0 AS fresh FROM q),
u2 AS (SELECT known, score FROM q, o WHERE known IS NOT NULL AND (held OR NOT fresh)),
m AS (SELECT avg(score) FILTER (known = 'allow') AS ma, avg(score) FILTER (known = 'block') AS mb,
  stddev_pop(score) FILTER (known = 'allow') AS sa, stddev_pop(score) FILTER (known = 'block') AS sb FROM u2),
z AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN NULL WHEN sa + sb = 0 THEN (ma + mb) / 2 ELSE (ma * sb + mb * sa) / (sa + sb) END AS t FROM m)
SELECT page_id, host, path, rule, coalesce(r.known, CASE WHEN t IS NULL OR score >= t THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN q USING (rid), z
"""


ORACLE_SQL = _oracle()
