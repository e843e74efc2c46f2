"""Licence scan by the Dice coefficient over word bigrams, with built-in functions only.

A segment is a line of a text, or a whole text of several lines.  It is
normalised (lower case, anything but letters and digits a blank) and its set
of word bigrams compared with that of each template:
``dice = 2 * shared / (segment + template)``.  Because ``shared`` is at most
the smaller size, a segment can only reach ``t`` if its size lies between
``b * t / (2 - t)`` and ``b * (2 - t) / t`` of a template's size ``b``; these
bounds drop templates and segments.  By the same bounds a match shares most of
a template's bigrams, so a few of them are chosen of which every match holds
one; segments without any of these, or of their words, go before bigrams are
made and compared.

Notices inside a line, or over several, are found as windows: runs of
consecutive words, across line ends, of at most ``(2 - t) / t`` times the
template's length.
Of a template's windows that overlap the one with the best score stays, of
different templates' the one that shares most bigrams; a match of a segment is
not told again as a window.  Complete licences are templates of windows only.

Defined results: null, empty and one-word texts match nothing; of equal scores
the template first by name wins; repeated rows each get their matches; an
empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bind, stored, table

#: Notices and short texts by which public licences are declared.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Complete licences, a file each, found as windows beside the notices.
TEXTS: dict[str, str] = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: The least Dice coefficient of a match, in hundredths.
PERCENT = 80


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _bigrams(w: Column) -> Column:
    """The distinct bigrams of a bound array of two words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1])))


def _fits(size: Column, template: int, percent: int) -> Column:
    """Whether a set of this size can reach the score with the template's."""
    return (size * (200 - percent) >= percent * template) & (size * percent <= (200 - percent) * template)


def _keys(b: list[str], percent: int) -> list[str]:
    """Bigrams of a template of which every match holds at least one.

    The smallest size in bounds gives the fewest bigrams that a match shares;
    it cannot miss more than the others, so it meets any larger choice.  Long
    bigrams, which are rarer, are chosen.
    """
    smallest = -(-percent * len(b) // (200 - percent))
    shared = -(-percent * (smallest + len(b)) // 200)
    return sorted(b, key=lambda x: (-len(x), x))[: len(b) - shared + 1]


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best template of every matching segment, and the matching windows elsewhere.

    Columns: id, segment (line number from 1; 0: the whole text of several
    lines; of a window the line it begins on), license, n_bigrams, n_shared,
    dice.
    """
    sets = _sets(TEMPLATES if templates is None else templates)
    listed = {**TEMPLATES, **TEXTS} if templates is None else templates
    every = _sets(listed)
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), plain.alias("_plain"))
    # stored, so that the scan of all texts stays a small, compiled stage and the scores see candidates only
    rows = stored(rows.where(F.arrays_overlap(F.split("_plain", "[ \n]+"), _literals(_key_words(every, percent)))), "license-candidates")
    lines = stored(_segments(rows, sets, percent), "license-segments")
    out = lines.unionByName(_windows(rows, lines, every, {name: len(_words(listed[name])) for name in every}, percent))
    return out.select(F.col("_id").alias(id_col), "segment", "license", "n_bigrams", "n_shared", "dice")


def _sets(templates: Mapping[str, str]) -> dict[str, list[str]]:
    sets = {name: bigrams_of(t) for name, t in sorted(templates.items())}
    return {name: b for name, b in sets.items() if b}


def _literals(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def _key_words(sets: Mapping[str, list[str]], percent: int) -> list[str]:
    return sorted({max(k.split(" "), key=lambda w: (len(w), w)) for b in sets.values() for k in _keys(b, percent)})


def _segments(rows: DataFrame, sets: Mapping[str, list[str]], percent: int) -> DataFrame:
    """The best template of every line and whole text."""
    keys = sorted({k for b in sets.values() for k in _keys(b, percent)})
    least = min((-(-percent * len(b) // (200 - percent)) for b in sets.values()), default=1)
    whole = F.array(F.struct(F.lit(0).alias("segment"), F.regexp_replace(F.btrim(F.col("_plain"), F.lit(" \n")), "[ \n]+", " ").alias("words")))
    n_words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) + 1
    # the number of words bounds that of the distinct bigrams from above only
    long_enough = lambda s: n_words(s["words"]) > least
    segments = F.transform(F.split(F.col("_plain"), "\n"), lambda x, i: F.struct((i + 1).alias("segment"), F.btrim(x).alias("words")))
    several = F.when(F.instr("_plain", "\n") > 0, whole).otherwise(F.filter(whole, lambda x: F.lit(False)))
    most = max((len(b) * (200 - percent) // percent for b in sets.values()), default=0)
    rows = rows.select("_row", "_id", F.explode(F.filter(F.concat(several, segments), long_enough)).alias("s")).select("_row", "_id", "s.segment", F.split("s.words", " ").alias("_w"))
    rows = rows.where(F.arrays_overlap("_w", _literals(_key_words(sets, percent))))
    rows = rows.select("_row", "_id", "segment", bind(F.col("_w"), _bigrams).alias("_b")).withColumn("_n", F.size("_b"))
    rows = rows.where(F.col("_n").between(least, most) & F.arrays_overlap("_b", _literals(keys)))

    def score(name: str, b: list[str]) -> Column:
        total = F.col("_n") + len(b)
        hit = lambda k: F.when(200 * k >= percent * total, F.struct((2.0 * k / total).alias("dice"), F.lit(name).alias("license"), k.alias("n_shared")))
        shared = F.size(F.array_intersect(F.col("_b"), _literals(b)))
        return F.when(_fits(F.col("_n"), len(b), percent), bind(shared, hit))

    scored = [score(name, b) for name, b in sets.items()]
    best = F.aggregate(F.array(*scored), F.lit(None).cast("struct<dice:double,license:string,n_shared:int>"), lambda a, x: F.when(x.isNull(), a).when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    rows = rows.withColumn("_best", best).where("_best is not null")
    return rows.select("_row", "_id", "segment", F.col("_best.license").alias("license"), F.col("_n").alias("n_bigrams"), F.col("_best.n_shared").alias("n_shared"), F.col("_best.dice").alias("dice"))


def _apart(found: Column) -> Column:
    """Of a list of windows, those that overlap no earlier one that stays."""
    meets = lambda x: lambda y: (y["first"] <= x["last"]) & (x["first"] <= y["last"])
    return bind(F.sort_array(found), lambda c: F.aggregate(c, F.filter(c, lambda x: F.lit(False)), lambda a, x: F.when(F.exists(a, meets(x)), a).otherwise(F.concat(a, F.array(x)))))


def _windows(rows: DataFrame, lines: DataFrame, sets: Mapping[str, list[str]], n_words: Mapping[str, int], percent: int) -> DataFrame:
    """The best matching runs of words, across line ends too, that ``lines`` do not hold."""
    spark = rows.sparkSession
    shape = "license string, bigrams array<string>, need int, reach int"
    least = lambda b: -(-percent * len(b) // (200 - percent))
    known = [(name, b, -(-percent * (least(b) + len(b)) // 200), (n_words[name] - 1) * (200 - percent) // percent) for name, b in sets.items()]
    listed = F.broadcast(spark.createDataFrame(known, shape))  # the templates
    keys = sorted({k for b in sets.values() for k in _keys(b, percent)})
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1]))
    text = F.split(F.regexp_replace(F.btrim(F.col("_plain"), F.lit(" \n")), "[ \n]+", " "), " ")
    words = rows.select("_row", text.alias("_w")).where(F.size("_w") > 1)
    words = stored(words.select("_row", bind(F.col("_w"), pairs).alias("_g")).where(F.arrays_overlap("_g", _literals(keys))), "license-words")
    one = F.broadcast(listed.select("license", "need", F.explode("bigrams").alias("_b")))
    spots = words.select("_row", F.posexplode("_g").alias("_at", "_b")).join(one, "_b")
    hits = spots.groupBy("_row", "license").agg(F.first("need").alias("need"), F.size(F.collect_set("_b")).alias("_k"), F.sort_array(F.collect_list("_at")).alias("_hits"))
    hits = stored(hits.where(F.col("_k") >= F.col("need")).drop("need", "_k"), "license-hits").join(listed, "license")
    # dropping bigrams of no template from an end, or adding a template's there, never lowers the score:
    # the best windows begin and end where a run of the template's bigrams does
    h, n = F.col("_hits"), F.size("_hits")
    each = F.transform(h, lambda x, i: F.struct(x.alias("at"), i.alias("i")))
    begins = F.filter(each, lambda x: (x["i"] <= n - F.col("need")) & ((x["i"] == 0) | (F.get(h, x["i"] - 1) != x["at"] - 1)))
    ends = F.filter(each, lambda x: (x["i"] >= F.col("need") - 1) & ((x["i"] == n - 1) | (F.get(h, x["i"] + 1) != x["at"] + 1)))
    near = lambda a: lambda z: (z["i"] - a["i"] + 1 >= F.col("need")) & (z["at"] - a["at"] < F.col("reach"))
    spans = bind(ends, lambda e: F.flatten(F.transform(begins, lambda a: F.transform(F.filter(e, near(a)), lambda z: F.struct(a["at"].alias("first"), z["at"].alias("last"))))))
    tried = hits.select("_row", "license", "bigrams", F.explode(spans).alias("_s")).join(words, "_row")
    cut = F.slice("_g", F.col("_s.first") + 1, F.col("_s.last") - F.col("_s.first") + 1)
    counted = bind(cut, lambda c: F.struct(F.size(F.array_distinct(c)).alias("n"), F.size(F.array_intersect(c, "bigrams")).alias("k")))
    tried = tried.select("_row", "license", "_s", F.size("bigrams").alias("_m"), counted.alias("_c")).where(200 * F.col("_c.k") >= percent * (F.col("_c.n") + F.col("_m")))
    dice = 2.0 * F.col("_c.k") / (F.col("_c.n") + F.col("_m"))
    span = [F.col("_s.first").alias("first"), F.col("_s.last").alias("last"), F.col("_c.n").alias("n_bigrams"), F.col("_c.k").alias("n_shared")]
    best = tried.groupBy("_row", "license").agg(F.collect_list(F.struct((-dice).alias("worse"), (-F.col("_c.k")).alias("fewer"), *span)).alias("_f")).select("_row", "license", F.explode(_apart(F.col("_f"))).alias("x"))
    best = best.groupBy("_row").agg(F.collect_list(F.struct("x.fewer", "x.worse", "license", "x.first", "x.last", "x.n_bigrams", "x.n_shared")).alias("_f")).select("_row", F.explode(_apart(F.col("_f"))).alias("x")).select("_row", "x.*")
    sizes = F.transform(F.split("_plain", "\n"), lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != "")))
    start = lambda word: F.struct(word.cast("int").alias("left"), F.lit(1).alias("line"), F.lit(False).alias("done"))
    past = lambda a, c: F.when(a["done"] | (a["left"] < c), F.struct(a["left"].alias("left"), a["line"].alias("line"), F.lit(True).alias("done"))).otherwise(F.struct((a["left"] - c).alias("left"), (a["line"] + 1).alias("line"), F.lit(False).alias("done")))
    line = lambda word: bind(sizes, lambda c: F.aggregate(c, start(word), past))["line"]
    placed = best.join(rows, "_row").withColumns({"segment": line(F.col("first")), "_last": line(F.col("last") + 1)})
    # a segment's own match is not told again; a second one beside it, sharing none of its bigrams, is
    held = lines.select("_row", F.col("segment").alias("_seg"), F.col("license").alias("_lic"), F.col("n_bigrams").alias("_n"), F.col("n_shared").alias("_k"))
    inside = (F.col("_seg") == 0) | ((F.col("_seg") == F.col("segment")) & (F.col("_seg") == F.col("_last")))
    again = (F.col("_lic") == F.col("license")) | (F.col("_k") + F.col("n_shared") > F.col("_n"))
    told = placed.alias("p").join(held.alias("l"), (F.col("p._row") == F.col("l._row")) & inside & again, "left_anti")
    return told.select("_row", "_id", "segment", "license", "n_bigrams", "n_shared", (-F.col("worse")).alias("dice"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, [{', '.join(map(quote, bigrams_of(t)))}])" for n, t in sorted(TEMPLATES.items()))
    return rf"""
WITH t(license, b) AS (VALUES {values}),
p AS (SELECT doc_id, row_number() OVER () AS rid, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS x FROM documents),
l AS (SELECT doc_id, rid, unnest(string_split(x, chr(10))) AS s, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS segment FROM p
      UNION ALL SELECT doc_id, rid, x, 0 FROM p WHERE contains(x, chr(10))),
w AS (SELECT doc_id, rid, CAST(segment AS INTEGER) AS segment, regexp_extract_all(s, '[^ \n]+') AS w FROM l),
b AS (SELECT doc_id, rid, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, rid, segment, license, CAST(len(b.b) AS INTEGER) AS n_bigrams, CAST(len(list_intersect(b.b, t.b)) AS INTEGER) AS n_shared, len(b.b) + len(t.b) AS total
      FROM b, t WHERE len(b.b) * {200 - PERCENT} >= {PERCENT} * len(t.b) AND len(b.b) * {PERCENT} <= {200 - PERCENT} * len(t.b))
SELECT doc_id, segment, license, n_bigrams, n_shared, 2.0::DOUBLE * n_shared / total AS dice FROM m
WHERE 200 * n_shared >= {PERCENT} * total
QUALIFY row_number() OVER (PARTITION BY rid, segment ORDER BY 2.0::DOUBLE * n_shared / total DESC, license) = 1
"""


ORACLE_SQL = _oracle()
