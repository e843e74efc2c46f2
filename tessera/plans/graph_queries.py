"""Graph lookups and traversals over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.operators import answering
from tessera.operators import graph as g
from tessera.plans.catalog import CATALOGUE_SQL, DOMAIN, FLAWED_SQL, TRIALS_SQL, catalogue, flawed, trials
from tessera.plans.registry import Book

BOOK = Book()


def _graph(spark: SparkSession, sf_dir: str, view=trials) -> tuple[DataFrame, DataFrame]:
    nodes = view(spark, sf_dir)
    return nodes, g.edges_of(nodes)


@BOOK.add(f"WITH {TRIALS_SQL} SELECT src, dst, pos FROM e")
def graph_edges(spark, sf_dir):
    """The edge table of the node table."""
    return _graph(spark, sf_dir)[1].select("src", "dst", "pos")


@BOOK.add(f"WITH {TRIALS_SQL} SELECT src AS id, pos, dst AS prerequisite, label FROM e JOIN n ON dst = n.id")
def graph_prerequisites(spark, sf_dir):
    """J1, G1."""
    return g.prerequisites(*_graph(spark, sf_dir)).drop("domain")


@BOOK.add(f"""WITH {FLAWED_SQL} SELECT dst AS id, row_number() OVER (PARTITION BY dst ORDER BY src) AS place, src AS dependent
FROM (SELECT DISTINCT src, dst FROM k) QUALIFY place <= 5""")
def graph_dependents(spark, sf_dir):
    """The first five dependents in file order."""
    return g.dependents(*_graph(spark, sf_dir, flawed)).drop("domain")


@BOOK.add(f"WITH {FLAWED_SQL} SELECT src, dst, pos FROM e WHERE dst NOT IN (SELECT id FROM n)")
def graph_dangling(spark, sf_dir):
    """Dependencies on nodes that are not there."""
    nodes, edges = _graph(spark, sf_dir, flawed)
    return g.dangling(edges, nodes).select("src", "dst", "pos")


@BOOK.add(f"""WITH {FLAWED_SQL}, b AS (
  SELECT id, 0 AS branch, 0::BIGINT AS place, id AS member FROM n
  UNION ALL SELECT src, 1, pos, dst FROM k
  UNION ALL SELECT * FROM (SELECT dst, 2, row_number() OVER (PARTITION BY dst ORDER BY src) AS place, src FROM (SELECT DISTINCT src, dst FROM k)) WHERE place <= 5)
SELECT id, branch, place, member FROM b QUALIFY row_number() OVER (PARTITION BY id, member ORDER BY branch, place) = 1""")
def graph_neighbourhood(spark, sf_dir):
    """A node with its prerequisites and first dependents, first mention kept."""
    return g.neighbourhood(*_graph(spark, sf_dir, flawed)).drop("domain")


_WALK = """, w AS (
  SELECT id AS start, id AS node, 0 AS depth, [id] AS path, CAST([] AS BIGINT[]) AS key FROM n
  UNION ALL SELECT start, dst, depth + 1, list_append(path, dst), list_append(key, pos) FROM w JOIN k ON w.node = k.src WHERE depth < 8)
, f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY depth, key) = 1)"""


@BOOK.add(f"WITH RECURSIVE {FLAWED_SQL}{_WALK} SELECT start, node, depth, array_to_string(key, '.') AS visit_order FROM f")
def graph_ancestors(spark, sf_dir):
    """Everything a node rests on, in the order of a breadth-first search."""
    nodes, edges = _graph(spark, sf_dir, flawed)
    found = g.ancestors(nodes.select("domain", F.col("id").alias("start")), edges, nodes)
    return found.select("start", "node", "depth", F.array_join(F.transform("key", lambda x: x.cast("string")), ".").alias("visit_order"))


@BOOK.add(f"""WITH RECURSIVE {FLAWED_SQL}{_WALK}
SELECT n.id AS start, 1::BIGINT AS "end", array_to_string(path, '>') AS path FROM n LEFT JOIN f ON f.start = n.id AND node = 1""")
def graph_directed_paths(spark, sf_dir):
    """The shortest way from every node to the root, first-listed dependency first."""
    nodes, edges = _graph(spark, sf_dir, flawed)
    pairs = nodes.select("domain", F.col("id").alias("start"), F.lit(1).cast("long").alias("end"))
    return g.directed_paths(pairs, edges, nodes).select("start", "end", _ids("path"))


def _ids(name: str):
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ">").alias(name)


_PAIRS = "p AS (SELECT id AS a, lead(id) OVER (ORDER BY id) AS b FROM n WHERE tax = 'SPON')"


def _supplier_pairs(nodes: DataFrame) -> DataFrame:
    """Every supplier with the next one: ids are consecutive, so no global window is needed."""
    some = nodes.where("taxonomy_id = 'SPON'")
    following = some.select("domain", F.col("id").alias("b"), (F.col("id") - 1).alias("a"))
    return some.select("domain", F.col("id").alias("a")).join(following, ["domain", "a"])


# the orders of a trial lead nowhere shorter than the nation and region above two suppliers, so the search stays among the rest
def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The flawed graph without its trials."""
    nodes = flawed(spark, sf_dir).where("taxonomy_id <> 'TRIAL'")
    return nodes, g.edges_of(nodes)


_UNDIRECTED = f"""WITH RECURSIVE {FLAWED_SQL}, u AS (SELECT src AS x, dst AS y FROM k WHERE src < 10000000 UNION SELECT dst, src FROM k WHERE src < 10000000), {_PAIRS},
w AS (SELECT DISTINCT a AS start, a AS node, [a] AS path FROM p WHERE b IS NOT NULL
  UNION ALL SELECT start, y, list_append(path, y) FROM w JOIN u ON node = x WHERE NOT list_contains(path, y) AND len(path) < 9),
s AS (SELECT a, b, coalesce(path, [a, b]) AS path FROM p LEFT JOIN w ON w.start = a AND w.node = b WHERE b IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY len(path), path) = 1)"""


@BOOK.add(_UNDIRECTED + " SELECT a AS start, b AS \"end\", array_to_string(path, '>') AS path FROM s")
def graph_undirected_paths(spark, sf_dir):
    """Shortest undirected paths between consecutive suppliers."""
    nodes, edges = _catalogue(spark, sf_dir)
    pairs = _supplier_pairs(nodes).select("domain", F.col("a").alias("start"), F.col("b").alias("end"))
    return g.undirected_paths(pairs, edges, nodes).select("start", "end", _ids("path"))


@BOOK.add(_UNDIRECTED + """, b AS (
  SELECT a, b, 0 AS branch, unnest(path) AS member, unnest(range(0, len(path))) AS place FROM s
  UNION ALL SELECT s.a, s.b, 1, x.dst, x.pos FROM s JOIN k x ON x.src = s.a JOIN k y ON y.src = s.b AND y.dst = x.dst
  UNION ALL SELECT s.a, s.b, 2, x.dst, x.pos FROM s JOIN k x ON x.src = s.a AND x.pos < 3
  UNION ALL SELECT s.a, s.b, 3, x.dst, x.pos FROM s JOIN k x ON x.src = s.b AND x.pos < 3)
SELECT a, b, branch, CAST(place AS BIGINT) AS place, member FROM b QUALIFY row_number() OVER (PARTITION BY a, b, member ORDER BY branch, place) = 1""")
def graph_path_neighbourhood(spark, sf_dir):
    """G7, G8."""
    nodes, edges = _catalogue(spark, sf_dir)
    return g.path_neighbourhood(_supplier_pairs(nodes), edges, nodes).drop("domain")


@BOOK.add(f"""WITH {TRIALS_SQL}, t(tag) AS (VALUES ('spon'), ('TRI'), ('S'), (''), ('none')),
c AS (SELECT tag, tax FROM t, (SELECT DISTINCT tax FROM n) WHERE tax = upper(tag)),
l AS (SELECT tag, tax FROM t, (SELECT DISTINCT tax FROM n) WHERE tag <> '' AND contains(tax, upper(tag)) AND tag NOT IN (SELECT tag FROM c))
SELECT tag, id, label FROM n JOIN (SELECT * FROM c UNION ALL SELECT * FROM l) USING (tax)""")
def graph_category_members(spark, sf_dir):
    """Exact category, else loose match, nothing for an empty tag."""
    tags = spark.createDataFrame([(DOMAIN, x) for x in ("spon", "TRI", "S", "", "none")], "domain string, tag string")
    return g.members(trials(spark, sf_dir), tags).select("tag", "id", "label")


@BOOK.add(f"""WITH {TRIALS_SQL}, o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1)
SELECT n.id, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree, o.k IS NULL AS is_root, i.k IS NULL AS is_leaf
FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def graph_degrees(spark, sf_dir):
    """G10, G11."""
    return g.degrees(*_graph(spark, sf_dir)).drop("domain")


@BOOK.add(f"WITH {TRIALS_SQL} SELECT tax AS taxonomy_id, count(*) AS nodes, CAST(sum(len(deps)) AS BIGINT) AS edges FROM n GROUP BY 1")
def graph_categories(spark, sf_dir):
    """Nodes and edges by category."""
    return trials(spark, sf_dir).groupBy("taxonomy_id").agg(F.count("*").alias("nodes"), F.sum(F.size("dependencies")).cast("long").alias("edges"))


@BOOK.add(f"WITH {CATALOGUE_SQL}, {_PAIRS} SELECT a, b, x.dst AS common FROM p JOIN e x ON x.src = a JOIN e y ON y.src = b AND y.dst = x.dst")
def graph_shared_prerequisites(spark, sf_dir):
    """J7."""
    nodes, edges = _graph(spark, sf_dir, catalogue)
    return g.shared(edges, _supplier_pairs(nodes)).drop("domain")


@BOOK.add(f"""WITH {TRIALS_SQL} SELECT x.dst AS a, y.dst AS b, x.src AS common FROM e x JOIN e y ON x.src = y.src
WHERE x.dst BETWEEN 100 AND 999 AND y.dst BETWEEN 50 AND 79""")
def graph_shared_dependents(spark, sf_dir):
    """What rests on both a nation and a status."""
    nodes, edges = _graph(spark, sf_dir)
    a = nodes.where("taxonomy_id = 'COND'").select("domain", F.col("id").alias("a"))
    b = nodes.where("taxonomy_id = 'STATUS'").select("domain", F.col("id").alias("b"))
    return g.shared(edges, a.join(b, "domain"), False).drop("domain")


_NCT = r"list_sort(list_distinct(regexp_extract_all(upper({0}), '\bNCT\d{{8}}\b')))"


@BOOK.add(f"""WITH {TRIALS_SQL}, d AS (SELECT src AS id, string_agg(label || ' [' || tax || ']', '; ' ORDER BY pos) AS needs, string_agg(label, ' ') AS l FROM e JOIN n ON dst = n.id GROUP BY 1),
r AS (SELECT dst AS id, string_agg(label || ' [' || tax || ']', '; ' ORDER BY src, pos) AS needed, string_agg(label, ' ') AS l FROM e JOIN n ON src = n.id GROUP BY 1),
x AS (SELECT n.*, needs, needed, array_to_string({_NCT.format("concat_ws(' ', label, d.l, r.l)")}, ', ') AS ids FROM n LEFT JOIN d USING (id) LEFT JOIN r USING (id))
SELECT 'trade:node:' || id AS document_id, 'trade' AS domain, 'node' AS kind, id AS node_id, label, tax AS taxonomy_ids, ids AS nct_ids,
  'Document kind: graph node' || chr(10) || 'Domain: trade' || chr(10) || 'Node label: ' || label || chr(10) || 'Node type: ' || tax || chr(10) || 'Direct prerequisites (outgoing depends_on targets): ' || coalesce(needs, 'none')
  || chr(10) || 'Direct dependents (incoming depends_on sources): ' || coalesce(needed, 'none') || CASE WHEN ids <> '' THEN chr(10) || 'NCT/source identifiers present in this graph neighborhood: ' || ids ELSE '' END AS text FROM x""")
def graph_node_documents(spark, sf_dir):
    """The node documents of the whole graph."""
    return _flat(g.node_documents(*_graph(spark, sf_dir)))


@BOOK.add(f"""WITH {TRIALS_SQL}, x AS (SELECT src, dst, a.label AS al, b.label AS bl, a.tax AS sx, b.tax AS tx, array_to_string({_NCT.format("a.label || ' ' || b.label")}, ', ') AS ids FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id)
SELECT 'trade:edge:' || src || ':' || dst AS document_id, 'trade' AS domain, 'edge' AS kind, src AS source_node_id, dst AS target_node_id, al || ' depends_on ' || bl AS label,
  CASE WHEN sx = tx THEN sx ELSE least(sx, tx) || ', ' || greatest(sx, tx) END AS taxonomy_ids, ids AS nct_ids,
  'Document kind: typed graph edge' || chr(10) || 'Domain: trade' || chr(10) || 'Typed edge: ' || al || ' depends_on ' || bl || chr(10) || 'Source node: ' || al || ' [' || sx || ']' || chr(10) || 'Target node: ' || bl || ' [' || tx || ']'
  || CASE WHEN ids <> '' THEN chr(10) || 'NCT/source identifiers present on this edge: ' || ids ELSE '' END AS text FROM x""")
def graph_edge_documents(spark, sf_dir):
    """The edge documents of the whole graph."""
    return _flat(g.edge_documents(*_graph(spark, sf_dir)))


def _flat(documents: DataFrame) -> DataFrame:
    lists = {c: F.array_join(c, ", ") for c in ("taxonomy_ids", "nct_ids")}
    return documents.withColumns(lists)


@BOOK.add(f"""WITH {TRIALS_SQL}, d AS (SELECT 'node' AS kind FROM n UNION ALL SELECT 'edge' FROM e)
SELECT 'trade' AS domain, kind, count(*) AS n FROM d GROUP BY kind UNION ALL SELECT NULL, kind, count(*) FROM d GROUP BY kind""")
def graph_document_totals(spark, sf_dir):
    """Documents by domain and kind."""
    nodes, edges = _graph(spark, sf_dir)
    return g.document_totals(g.node_documents(nodes, edges).select("domain", "kind").unionAll(g.edge_documents(nodes, edges).select("domain", "kind")))


_LABEL_CASES = "CASE id % 4 WHEN 0 THEN upper(label) WHEN 1 THEN 'about ' || label || ' today' WHEN 2 THEN substr(label, 1, length(label) - 2) ELSE label END"


@BOOK.add(f"""WITH {CATALOGUE_SQL}, q AS (SELECT id AS key, trim(lower({_LABEL_CASES})) AS s FROM n),
m AS (SELECT key, id AS node, CASE WHEN lower(label) = s THEN 0 WHEN contains(lower(label), s) THEN 1 ELSE 2 END AS tier
  FROM q, n WHERE contains(lower(label), s) OR contains(s, lower(label)))
SELECT key, node, tier FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, node) = 1""")
def graph_resolution(spark, sf_dir):
    """Exact, then looser matches of a text with a label."""
    nodes = catalogue(spark, sf_dir)
    cases = F.when(F.col("id") % 4 == 0, F.upper("label")).when(F.col("id") % 4 == 1, F.concat(F.lit("about "), "label", F.lit(" today"))).when(F.col("id") % 4 == 2, F.expr("substr(label, 1, length(label) - 2)")).otherwise(F.col("label"))
    return g.resolve(nodes.select("domain", F.col("id").alias("key"), cases.alias("text")), nodes).select("key", "node", "tier")


_ASKED = "['T1_entity','T2_dependency','T3_path','T4_aggregate','T9'][1 + CAST(id % 5 AS INT)]"


@BOOK.add(f"""WITH RECURSIVE {TRIALS_SQL}, q AS (SELECT *, {_ASKED} AS type FROM n),
c AS (SELECT id AS start, id AS node, CAST([] AS BIGINT[]) AS key FROM q WHERE type = 'T3_path' AND id % 2 = 1 UNION ALL SELECT start, dst, key || [pos] FROM c JOIN e ON src = node),
w AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY len(key), key) - 1 AS place FROM (SELECT DISTINCT ON (start, node) start, node, key FROM c ORDER BY start, node, len(key), key)),
b AS (SELECT dst AS id, src AS member, row_number() OVER (PARTITION BY dst ORDER BY src) AS place FROM e QUALIFY place <= 5),
m AS (SELECT id, 0 AS branch, 0 AS place, id AS member FROM q WHERE type IN ('T1_entity', 'T2_dependency')
  UNION ALL SELECT src, 1, pos, dst FROM e JOIN q ON id = src WHERE type IN ('T1_entity', 'T2_dependency')
  UNION ALL SELECT id, 2, place, member FROM b JOIN q USING (id) WHERE type = 'T1_entity'
  UNION ALL SELECT id, 0, unnest([0, 1]), unnest([id, coalesce(deps[1], id)]) FROM q WHERE type = 'T3_path' AND id % 2 = 0
  UNION ALL SELECT start, 0, place, node FROM w
  UNION ALL SELECT q.id, 0, n.id, n.id FROM q JOIN n ON n.tax = 'FRAME' WHERE type = 'T4_aggregate' AND q.id % 2 = 0
  UNION ALL SELECT id, 0, unnest([0, 2]), id FROM q WHERE type = 'T4_aggregate' AND id % 2 = 1)
SELECT id, CAST(branch AS INTEGER) AS branch, CAST(place AS BIGINT) AS place, CAST(member AS BIGINT) AS member FROM m""")
def annotated_members(spark, sf_dir):
    """The nodes of questions by their annotations, by labels where those are missing."""
    nodes, edges = _graph(spark, sf_dir)
    even, kind = F.col("id") % 2 == 0, F.col("id") % 5
    kinds = F.array(*[F.lit(x) for x in ("T1_entity", "T2_dependency", "T3_path", "T4_aggregate", "T9")])
    path = F.array("id", F.coalesce(F.get("dependencies", F.lit(0)), F.col("id")))
    asked = nodes.select(
        "domain", "id", F.element_at(kinds, (kind + 1).cast("int")).alias("type"), F.concat(F.lit("What are the prerequisites for "), "label", F.lit("?")).alias("query"),
        F.when(kind < 2, F.array("label")).when((kind == 3) & ~even, F.array("label", F.lit("nobody here"), F.upper("label"))).alias("ground_truth"),
        F.when(even | (kind == 2), F.col("id")).alias("concept_id"), F.when((kind == 2) & even, path).alias("path_ids"), F.when((kind == 3) & even, "FRAME").alias("taxonomy_id"),
        F.lit(None).cast("long").alias("concept_id_a"), F.lit(None).cast("long").alias("concept_id_b"),
    )
    return answering.annotated(asked, nodes, edges).select("id", "branch", "place", "member")


HEADER = "Relevant concepts:"


@BOOK.add(f"""WITH {CATALOGUE_SQL},
q AS (SELECT id AS question, 'What are the prerequisites for ' || label || '?' AS text, id FROM n),
d AS (SELECT src AS id, string_agg(label, ', ' ORDER BY pos) AS needs, list(label ORDER BY pos) AS labels FROM e JOIN n ON dst = n.id GROUP BY 1),
m AS (SELECT id, 0 AS b, 0::BIGINT AS p, id AS member FROM n UNION ALL SELECT src, 1, pos, dst FROM e),
l AS (SELECT m.id, b, p, member, '  [' || tax || '] ' || label || ' | prerequisites: ' || coalesce(needs, 'none') AS line FROM m JOIN n ON member = n.id LEFT JOIN d ON d.id = member),
c AS (SELECT id, '{HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY b, p, member) AS context FROM l GROUP BY 1)
SELECT question, text, context, CAST(len(regexp_extract_all(context, '\\S+')) AS INTEGER) AS context_tokens, 1.0::DOUBLE AS f1, true AS exact
FROM q JOIN c USING (id)""")
def question_to_score(spark, sf_dir):
    """From question texts alone to scored answers."""
    nodes, edges = _graph(spark, sf_dir, catalogue)
    asked = nodes.select("domain", F.col("id").alias("question"), F.concat(F.lit("What are the prerequisites for "), "label", F.lit("?")).alias("text"))
    about = asked.select("domain", F.col("question").alias("key"), F.regexp_extract("text", r"(?i)prerequisites? for (.+?)\??$", 1).alias("text"))
    found = g.resolve(about, nodes).select(F.col("key").alias("question"), F.col("node").alias("id"))
    own = found.select("question", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("place"), F.col("id").alias("member"), F.lit("trade").alias("domain"))
    below = found.join(g.prerequisites(nodes, edges), "id").select("question", F.lit(1).alias("branch"), F.col("pos").alias("place"), F.col("prerequisite").alias("member"), "domain")
    context = g.serialised(own.unionAll(below), nodes, edges, ["question"], HEADER)
    answer = below.join(nodes.select("domain", F.col("id").alias("member"), "label"), ["domain", "member"]).groupBy("question").agg(g.in_order(F.col("label"), F.col("place")).alias("predicted"))
    gold = g.prerequisites(nodes, edges).groupBy(F.col("id").alias("question")).agg(g.in_order(F.col("label"), F.col("pos")).alias("expected"))
    out = asked.join(context, "question").join(answer, "question", "left").join(gold, "question", "left")
    score = scoring.set_f1(F.col("predicted"), F.col("expected"))
    return out.select("question", "text", "context", text.n_blank_tokens(F.col("context")).alias("context_tokens"), score["f1"].alias("f1"), score["exact"].alias("exact"))
