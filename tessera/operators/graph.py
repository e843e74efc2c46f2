"""Queries over typed dependency graphs.

Nodes: domain, id, label, dependencies (ids, in order), taxonomy_id, ord (file
order).  Edges: domain, src, dst, pos; ``src`` depends on ``dst``.  The order
of files and lists is part of many results, so it is carried in ``ord`` and
``pos`` and never left to the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import registry_ids
from tessera.storage import joined_by, stored

NODE_SCHEMA = "domain string, id long, label string, dependencies array<long>, taxonomy_id string, ord long"


def edges_of(nodes: DataFrame) -> DataFrame:
    """domain, src, dst, pos."""
    return nodes.select("domain", F.col("id").alias("src"), F.posexplode("dependencies").alias("pos", "dst")).select("domain", "src", "dst", F.col("pos").cast("long").alias("pos"))


def _lost(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain, dst: the targets that are no node, looked up once each, so a target of many edges is one row."""
    known = nodes.select("domain", F.col("id").alias("dst"))
    return joined_by(edges.select("domain", "dst").where("dst is not null").distinct().join(known, ["domain", "dst"], "left_anti"), "lost")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    found = edges.join(_lost(edges, nodes).withColumn("_lost", F.lit(True)), ["domain", "dst"], "left")
    return found.where("_lost or dst is null").select(*edges.columns)


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between nodes; those with an end that is no node drop out."""
    edges = edges.where("dst is not null")
    known = nodes.select("domain", F.col("id").alias("src"))
    return edges.join(_lost(edges, nodes), ["domain", "dst"], "left_anti").join(known, ["domain", "src"], "left_semi").select("domain", "src", "dst", "pos")


def in_order(value: Column, *order: Column) -> Column:
    """Aggregate: the values as an array in the given order."""
    keyed = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["v"])


def prerequisites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, id, pos, prerequisite, label: direct prerequisites in stored order; dangling ones drop out."""
    named = nodes.select("domain", F.col("id").alias("dst"), "label")
    return edges.join(named, ["domain", "dst"]).select("domain", F.col("src").alias("id"), "pos", F.col("dst").alias("prerequisite"), "label")


def dependents(nodes: DataFrame, edges: DataFrame, cap: int | None = 5) -> DataFrame:
    """domain, id, place, dependent: the first ``cap`` dependents of each node by file order, each once."""
    placed = edges.select("domain", "src", "dst").distinct().join(nodes.select("domain", F.col("id").alias("dst")), ["domain", "dst"], "left_semi").join(nodes.select("domain", F.col("id").alias("src"), "ord"), ["domain", "src"])
    place = F.row_number().over(Window.partitionBy("domain", "dst").orderBy("ord", "src"))
    out = placed.withColumn("place", place)
    out = out if cap is None else out.where(F.col("place") <= cap)
    return out.select("domain", F.col("dst").alias("id"), F.col("place").cast("long").alias("place"), F.col("src").alias("dependent"))


def first_of_each(branches: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Rows (keys, branch, place, member) without later repeats of a member."""
    first = F.row_number().over(Window.partitionBy(*keys, member).orderBy("branch", "place"))
    return branches.withColumn("_first", first).where("_first = 1").drop("_first")


def neighbourhood(nodes: DataFrame, edges: DataFrame, cap: int = 5) -> DataFrame:
    """domain, id, branch, place, member: a node, its prerequisites, its first dependents."""
    own = nodes.select("domain", "id", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("place"), F.col("id").alias("member"))
    below = prerequisites(nodes, edges).select("domain", "id", F.lit(1).alias("branch"), F.col("pos").alias("place"), F.col("prerequisite").alias("member"))
    above = dependents(nodes, edges, cap).select("domain", "id", F.lit(2).alias("branch"), "place", F.col("dependent").alias("member"))
    return first_of_each(own.unionAll(below).unionAll(above), ["domain", "id"], "member")


# The lengths of the substrings by which texts are matched.
GRAMS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of ``size`` characters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner key, outer key) of one domain where the inner text is a substring of the outer.

    An inner text is looked up by the rarest of its substrings of the greatest
    length in ``GRAMS`` that it has, in an equi-join, so a beginning that many
    texts share gathers nothing; one with a substring that no outer text has is
    in none.  ``inner``: domain, i, s; ``outer``: domain, o, t; equal texts once each.
    Without t, the key o is the text itself and is moved once.
    """
    sizes = F.array(*[F.lit(n) for n in GRAMS])
    size = F.array_max(F.filter(sizes, lambda n: n <= F.length("s")))
    asked = inner.where("s <> ''").withColumn("n", size)
    wanted = F.broadcast(asked.select("n").distinct())  # a row for each length at most
    t = "t" if "t" in outer.columns else "o"
    grams = stored(outer.join(wanted, F.length(t) >= F.col("n")).select("domain", "n", *dict.fromkeys(("o", t)), F.explode(_grams(F.col(t), F.col("n"))).alias("g")), "grams")
    counts = grams.groupBy("domain", "n", "g").agg(F.count("*").alias("k"))
    each = asked.select("domain", "i", "s", "n", F.explode(_grams(F.col("s"), F.col("n"))).alias("g")).join(counts, ["domain", "n", "g"], "left")
    rarest = each.groupBy("domain", "i", "s", "n").agg(F.min_by("g", F.struct("k", "g")).alias("g"), F.count_if(F.col("k").isNull()).alias("_none")).where("_none = 0")
    hits = rarest.join(grams.hint("merge"), ["domain", "n", "g"])
    return hits.where(F.contains(t, F.col("s"))).select("domain", "i", "o")


def resolve(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, tier: the node that each text (domain, key, text) names.

    Tier 0: label equal but for case.  Tier 1: label contains the text.  Tier 2:
    text contains the label.  The lowest tier wins, in it the first in file
    order.  Equal texts, and equal labels, are looked up once.
    """
    asked = stored(texts.select("domain", "key", F.trim(F.lower("text")).alias("s")).where("s <> ''"), "texts")  # read by every tier
    named = stored(nodes.select("domain", F.lower("label").alias("t"), F.struct("ord", "id").alias("at")).groupBy("domain", "t").agg(F.min("at").alias("at")), "labels")
    once = asked.select("domain", "s").distinct()
    at = F.struct(F.lit(0).alias("tier"), F.col("at.ord").alias("ord"), F.col("at.id").alias("id")).alias("b")
    exact = stored(once.join(named.withColumnRenamed("t", "s"), ["domain", "s"]).select("domain", "s", at), "exact")
    rest = stored(once.join(exact.select("domain", "s"), ["domain", "s"], "left_anti"), "rest")
    labels = named.where("t is not null")
    inside = _contained(rest.select("domain", F.col("s").alias("i"), "s"), labels.select("domain", F.col("t").alias("o"))).select("domain", F.col("i").alias("s"), F.col("o").alias("t"), F.lit(1).alias("tier"))
    around = _contained(labels.select("domain", F.col("t").alias("i"), F.col("t").alias("s")), rest.select("domain", F.col("s").alias("o"))).select("domain", F.col("o").alias("s"), F.col("i").alias("t"), F.lit(2).alias("tier"))
    loose = inside.unionByName(around).join(named, ["domain", "t"])
    best = loose.groupBy("domain", "s").agg(F.min(F.struct("tier", F.col("at.ord").alias("ord"), F.col("at.id").alias("id"))).alias("b"))
    found = exact.unionByName(best)
    return asked.join(found, ["domain", "s"]).groupBy("key").agg(F.min("b").alias("b")).select("key", F.col("b.id").alias("node"), F.col("b.tier").alias("tier"))


def walk(starts: DataFrame, edges: DataFrame, ends: DataFrame | None = None, back: bool = False) -> DataFrame:
    """Breadth-first search from every start along src -> dst, to the last level.

    ``starts``: domain, start.  Gives domain, start, node, depth, path (ids from
    start to node) and key, the ``pos`` of each hop.  Of equally short paths the
    one with the smallest key is kept, which is the order in which a queue
    fed in ``pos`` order would find them.  Each level joins, keeps one row for
    each new (start, node) and is stored, so the plan does not grow; a level
    without new nodes is the last, so cycles end too.

    ``ends`` (domain, start, end): a start whose ends are all found goes no
    further.  ``back``: every edge can be walked both ways, so that new nodes
    need be told only from those of the last two levels.
    """
    step = stored(edges.select("domain", F.col("src").alias("node"), F.col("dst").alias("next"), "pos"), "steps").hint("merge")  # read by every level
    empty = F.array().cast("array<long>")
    keys = ["domain", "start", "node"]
    levels = [stored(starts.select("domain", "start").distinct().select("domain", "start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), empty.alias("key")), "walk")]
    left = None if ends is None else ends.select("domain", "start", F.col("end").alias("node")).distinct()
    while not levels[-1].isEmpty():
        now = levels[-1]
        if left is not None:
            left = stored(left.join(now.select(*keys), keys, "left_anti"), "sought")
            now = now.join(left.select("domain", "start").distinct(), ["domain", "start"], "left_semi")
        out = now.join(step, ["domain", "node"]).select("domain", "start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.concat("key", F.array("pos")).alias("key"))
        best = out.groupBy(*keys).agg(F.min_by("path", "key").alias("path"), F.min("key").alias("key"))
        for earlier in levels[-2:] if back else levels:
            best = best.join(earlier.select(*keys).hint("merge"), keys, "left_anti")
        levels.append(stored(best.select(*keys, F.lit(len(levels)).alias("depth"), "path", "key"), "walk"))
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    return seen


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges; a hop's ``pos`` is the id it leads to, so ties go to small ids."""
    there = edges.select("domain", "src", "dst", F.col("dst").alias("pos"))
    return there.unionAll(edges.select("domain", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("src").alias("pos"))).distinct()


def _ends(edges: DataFrame) -> DataFrame:
    """domain, node, to: the nodes with one neighbour, and that one; ``edges`` go both ways."""
    each = edges.where("src <> dst").groupBy("domain", F.col("src").alias("node")).agg(F.min("dst").alias("to"), F.max("dst").alias("_other"))
    return each.where(F.col("to") == F.col("_other")).select("domain", "node", "to")


def undirected_paths(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain, start, end, path: shortest undirected paths over nodes; ``[start, end]`` where there is none.

    A node with one neighbour stands on a path only as its end, and the path
    goes on from that neighbour.  So such nodes are left out of the search, and
    pairs that go on from the same two neighbours share it: the many of a hub
    are not walked from each other.
    """
    both = stored(both_ways(among(edges, nodes)), "both")
    ends = stored(_ends(both), "ends")
    own = pairs.select("domain", "start", "end").distinct()
    for side in ("start", "end"):
        own = own.join(ends.select("domain", F.col("node").alias(side), F.col("to").alias(f"_{side}")).hint("merge"), ["domain", side], "left")
    alone = F.col("start").eqNullSafe(F.col("end")) | F.coalesce((F.col("_start") == F.col("end")) & (F.col("_end") == F.col("start")), F.lit(False))
    own = stored(own.select("domain", "start", "end", alone.alias("alone"), *[F.coalesce(f"_{x}", x).alias(f"_{x}") for x in ("start", "end")]), "pairs")
    rest = own.where("not alone").select("domain", F.col("_start").alias("start"), F.col("_end").alias("end")).distinct()
    core = both
    for end in ("src", "dst"):
        core = core.join(ends.select("domain", F.col("node").alias(end)).hint("merge"), ["domain", end], "left_anti")
    found = walk(rest, core, rest, True).select("domain", F.col("start").alias("_start"), F.col("node").alias("_end"), F.col("path").alias("_path"))
    found = rest.select("domain", F.col("start").alias("_start"), F.col("end").alias("_end")).join(found, ["domain", "_start", "_end"])
    none = F.array().cast("array<long>")
    before, after = (F.when(F.col(x) != F.col(f"_{x}"), F.array(x)).otherwise(none) for x in ("start", "end"))
    way = F.when(F.col("start") == F.col("end"), F.array("start")).when(F.col("alone"), F.array("start", "end")).when(F.col("_path").isNotNull(), F.concat(before, "_path", after))
    path = own.join(joined_by(found, "found"), ["domain", "_start", "_end"], "left").select("domain", "start", "end", way.alias("path"))
    return pairs.join(path.hint("merge"), ["domain", "start", "end"], "left").select("domain", "start", "end", F.coalesce("path", F.array("start", "end")).alias("path"))


def _back(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, start, end, path: the paths that ``walk`` finds, from every node that leads to an end.

    The search runs from the ends against the edges; a node's path is that of
    the first of its edges, by ``pos``, that leads one level down.  A level
    goes on from the nodes that something depends on, which may be few.
    """
    keys = ["domain", "end", "node"]
    step = stored(edges.select("domain", "src", "dst", "pos"), "steps")  # read by every level
    target = joined_by(step.select("domain", F.col("dst").alias("node")).distinct(), "targets")
    levels = [stored(ends.select("domain", "end").distinct().select("domain", "end", F.col("end").alias("node"), F.array("end").alias("path")), "back")]
    while not levels[-1].isEmpty():
        front = joined_by(levels[-1].join(target, ["domain", "node"], "left_semi").withColumnRenamed("node", "dst"), "front")
        out = step.join(front, ["domain", "dst"]).select("domain", "end", F.col("src").alias("node"), "pos", F.concat(F.array("src"), "path").alias("path"))
        best = out.groupBy(*keys).agg(F.min_by("path", F.struct("pos", "path")).alias("path"))
        for earlier in levels:
            best = best.join(earlier.select(*keys).hint("merge"), keys, "left_anti")
        levels.append(stored(best, "back"))
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    return seen.select("domain", F.col("node").alias("start"), "end", "path")


def directed_paths(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain, start, end, path: shortest paths over nodes along dependencies, null where there is none.

    The search begins at the side of the pairs with fewer nodes.
    """
    edges = among(edges, nodes)
    some = pairs.agg(F.count_distinct("domain", "start").alias("starts"), F.count_distinct("domain", "end").alias("ends")).first()
    if some["ends"] < some["starts"]:
        found = _back(pairs, edges)
    else:
        found = walk(pairs, edges, pairs).select("domain", "start", F.col("node").alias("end"), "path")
    return pairs.join(found.hint("merge"), ["domain", "start", "end"], "left").select("domain", "start", "end", "path")


def ancestors(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``walk`` over nodes: a dependency that is no node is not visited.

    Where the starts depend directly on fewer nodes than they are, those are
    walked from once, and a start takes the best of what its edges lead to.
    """
    edges = among(edges, nodes)
    own = starts.select("domain", "start").distinct()
    first = edges.withColumnRenamed("src", "start").join(own, ["domain", "start"], "left_semi")
    target = stored(first.select("domain", F.col("dst").alias("start")).distinct(), "targets")
    if target.count() >= own.count():
        return walk(own, edges)
    below = joined_by(walk(target, edges).withColumnsRenamed({"start": "dst", "path": "_path", "key": "_key"}), "below")
    # dealt by start once: its rows stay together until they are settled
    reached = first.repartition("domain", "start").join(below, ["domain", "dst"]).where("node <> start")
    reached = reached.select("domain", "start", "node", F.struct((F.col("depth") + 1).alias("depth"), F.concat(F.array("pos"), "_key").alias("key"), F.concat(F.array("start"), "_path").alias("path")).alias("w"))
    best = reached.groupBy("domain", "start", "node").agg(F.min("w").alias("w")).select("domain", "start", "node", "w.depth", "w.path", "w.key")
    empty = F.array().cast("array<long>")
    return own.select("domain", "start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), empty.alias("key")).unionByName(best)


def members(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """domain, tag, id, label, ord: nodes of the category, else of the domain's categories that contain the tag.

    ``tags``: domain, tag, one row each; an empty tag has no loose match.
    """
    codes = nodes.select("domain", F.upper("taxonomy_id").alias("code")).distinct()  # as many rows as categories
    asked = tags.select("domain", "tag", F.upper(F.trim("tag")).alias("t"))
    exact = asked.join(codes.withColumn("t", F.col("code")), ["domain", "t"]).select("domain", "tag", "code")
    rest = asked.join(exact.select("domain", "tag"), ["domain", "tag"], "left_anti").where("t <> ''")
    loose = rest.join(codes, "domain").where(F.contains("code", F.col("t"))).select("domain", "tag", "code")
    return nodes.withColumn("code", F.upper("taxonomy_id")).join(exact.unionAll(loose), ["domain", "code"]).select("domain", "tag", "id", "label", "ord")


def shared(edges: DataFrame, pairs: DataFrame, prerequisites_: bool = True) -> DataFrame:
    """domain, a, b, common: what both depend on, or with False what depends on both."""
    own, other = ("src", "dst") if prerequisites_ else ("dst", "src")
    one = edges.select("domain", F.col(own).alias("a"), F.col(other).alias("common"))
    two = edges.select("domain", F.col(own).alias("b"), F.col(other).alias("common"))
    return pairs.join(one, ["domain", "a"]).join(two, ["domain", "b", "common"]).select("domain", "a", "b", "common").distinct()


def path_neighbourhood(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, cap: int = 3) -> DataFrame:
    """domain, a, b, branch, place, member: the path between two nodes, what
    both depend on, and the first prerequisites of each; nodes only."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():  # nothing asked, so the graph is not made ready for a search
        return pairs.select("domain", "a", "b", F.lit(0).alias("branch"), F.lit(0).cast("long").alias("place"), F.col("a").alias("member"))
    edges = among(edges, nodes)
    path = undirected_paths(pairs.select("domain", F.col("a").alias("start"), F.col("b").alias("end")), edges, nodes)
    on_path = path.select("domain", F.col("start").alias("a"), F.col("end").alias("b"), F.lit(0).alias("branch"), F.posexplode("path").alias("place", "member"))
    pos = edges.select("domain", F.col("src").alias("a"), F.col("dst").alias("common"), "pos")
    both = shared(edges, pairs).join(pos, ["domain", "a", "common"]).select("domain", "a", "b", F.lit(1).alias("branch"), F.col("pos").alias("place"), F.col("common").alias("member"))
    of = lambda side, branch: pairs.join(edges.where(F.col("pos") < cap).select("domain", F.col("src").alias(side), "dst", "pos"), ["domain", side]).select("domain", "a", "b", F.lit(branch).alias("branch"), F.col("pos").alias("place"), F.col("dst").alias("member"))
    return first_of_each(on_path.unionAll(both).unionAll(of("a", 2)).unionAll(of("b", 3)), ["domain", "a", "b"], "member")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, id, out_degree, in_degree, is_root, is_leaf (no prerequisites; nothing depends on it)."""
    out = edges.groupBy("domain", F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("domain", F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    all_ = nodes.select("domain", "id").join(out, ["domain", "id"], "left").join(into, ["domain", "id"], "left").na.fill(0, ["out_degree", "in_degree"])
    return all_.withColumn("is_root", F.col("out_degree") == 0).withColumn("is_leaf", F.col("in_degree") == 0)


def serialised(lists: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str], header: str) -> DataFrame:
    """keys, context: one line for each member in order, with its category and prerequisites.

    ``lists``: keys, domain, member, and the sort columns branch and place.
    """
    names = prerequisites(nodes, edges).groupBy("domain", F.col("id").alias("member")).agg(F.array_join(in_order(F.col("label"), F.col("pos")), ", ").alias("needs"))
    told = nodes.select("domain", F.col("id").alias("member"), "label", "taxonomy_id")
    line = F.concat(F.lit("  ["), "taxonomy_id", F.lit("] "), "label", F.lit(" | prerequisites: "), F.coalesce("needs", F.lit("none")))
    lines = lists.join(told, ["domain", "member"]).join(names, ["domain", "member"], "left").withColumn("line", line)
    return lines.groupBy(*keys).agg(F.concat(F.lit(header + "\n"), F.array_join(in_order(F.col("line"), F.col("branch"), F.col("place"), F.col("member")), "\n")).alias("context"))


def _checked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with label and type of both ends; a dependency that is no node is an error."""
    end = lambda name: nodes.select("domain", F.col("id").alias(name), F.col("label").alias(f"{name}_label"), F.col("taxonomy_id").alias(f"{name}_type"))
    both = edges.join(end("src"), ["domain", "src"]).join(end("dst"), ["domain", "dst"], "left")
    lost = F.raise_error(F.concat_ws(" ", F.col("domain"), F.lit("node"), F.col("src"), F.lit("depends on missing node"), F.col("dst"))).cast("string")
    return both.withColumn("dst_label", F.when(F.col("dst_type").isNull(), lost).otherwise(F.col("dst_label")))


def _lines(*parts: Column) -> Column:
    """A text of lines; null ones are left out."""
    return F.concat_ws("\n", *parts)


def _told(title: str, value) -> Column:
    return F.concat(F.lit(f"{title}: "), value)


def node_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document for each node: its label and type, what it depends on and
    what depends on it with their types, and the registry numbers of all of them.

    Columns: document_id, domain, kind, node_id, label, taxonomy_ids, nct_ids,
    text.  Prerequisites stand in stored order, dependents by id.  A node's
    document names all its dependents, so a hub's document is as long as its
    list; nothing else of a hub is gathered.
    """
    named = _checked(edges, nodes)
    typed = lambda end: F.concat(F.col(f"{end}_label"), F.lit(" ["), F.col(f"{end}_type"), F.lit("]"))
    needs = named.groupBy("domain", F.col("src").alias("id")).agg(F.array_join(in_order(typed("dst"), F.col("pos")), "; ").alias("needs"))
    # dependents are joined in runs of ids, runs in order, so only a hub's texts and not its rows meet
    runs = named.groupBy("domain", F.col("dst").alias("id"), F.shiftright("src", 12).alias("run")).agg(F.array_join(in_order(typed("src"), F.col("src"), F.col("pos")), "; ").alias("part"))
    back = runs.groupBy("domain", "id").agg(F.array_join(in_order(F.col("part"), F.col("run")), "; ").alias("needed"))
    near = lambda own, other: named.select("domain", F.col(own).alias("id"), F.explode(registry_ids(F.col(f"{other}_label"))).alias("number"))
    held = nodes.select("domain", "id", F.explode(registry_ids(F.col("label"))).alias("number")).unionAll(near("src", "dst")).unionAll(near("dst", "src"))
    few = held.groupBy("domain", "id", F.expr("left(number, 8)").alias("run")).agg(F.array_sort(F.collect_set("number")).alias("part"))
    numbers = few.groupBy("domain", "id").agg(F.flatten(in_order(F.col("part"), F.col("run"))).alias("nct_ids"))
    none = F.array().cast("array<string>")
    out = nodes.join(needs, ["domain", "id"], "left").join(back, ["domain", "id"], "left").join(numbers, ["domain", "id"], "left")
    out = out.withColumn("nct_ids", F.coalesce("nct_ids", none))
    text = _lines(
        F.lit("Document kind: graph node"), _told("Domain", F.col("domain")), _told("Node label", F.col("label")), _told("Node type", F.col("taxonomy_id")),
        _told("Direct prerequisites (outgoing depends_on targets)", F.coalesce("needs", F.lit("none"))),
        _told("Direct dependents (incoming depends_on sources)", F.coalesce("needed", F.lit("none"))),
        F.when(F.size("nct_ids") > 0, _told("NCT/source identifiers present in this graph neighborhood", F.array_join("nct_ids", ", "))),
    )
    name = F.concat_ws(":", "domain", F.lit("node"), F.col("id").cast("string")).alias("document_id")
    return out.select(name, "domain", F.lit("node").alias("kind"), F.col("id").alias("node_id"), "label", F.array("taxonomy_id").alias("taxonomy_ids"), "nct_ids", text.alias("text"))


def edge_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document for each dependency: both ends with their types and registry numbers.

    Columns: document_id, domain, kind, source_node_id, target_node_id, label,
    taxonomy_ids, nct_ids, text.
    """
    out = _checked(edges, nodes).withColumn("nct_ids", registry_ids(F.col("src_label"), F.col("dst_label")))
    label = F.concat("src_label", F.lit(" depends_on "), "dst_label")
    end = lambda e: F.concat(F.col(f"{e}_label"), F.lit(" ["), F.col(f"{e}_type"), F.lit("]"))
    text = _lines(
        F.lit("Document kind: typed graph edge"), _told("Domain", F.col("domain")), _told("Typed edge", label), _told("Source node", end("src")), _told("Target node", end("dst")),
        F.when(F.size("nct_ids") > 0, _told("NCT/source identifiers present on this edge", F.array_join("nct_ids", ", "))),
    )
    name = F.concat_ws(":", "domain", F.lit("edge"), F.col("src").cast("string"), F.col("dst").cast("string")).alias("document_id")
    kinds = F.array_sort(F.array_distinct(F.array("src_type", "dst_type"))).alias("taxonomy_ids")
    return out.select(name, "domain", F.lit("edge").alias("kind"), F.col("src").alias("source_node_id"), F.col("dst").alias("target_node_id"), label.alias("label"), kinds, "nct_ids", text.alias("text"))


def document_totals(documents: DataFrame) -> DataFrame:
    """domain, kind, n: documents by domain and kind; the domain is null in the totals over all."""
    return documents.groupingSets([("domain", "kind"), ("kind",)], "domain", "kind").agg(F.count("*").alias("n"))
