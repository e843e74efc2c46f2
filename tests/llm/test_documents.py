"""Operators on documents, each against a plain Python version."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import bpe, language_id, license_scan, near_duplicates, packing, quality_rules, substring_dedup, token_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def bag(rows):
    return Counter(map(tuple, rows))


def test_quality_counts(docs, rows, no_docs):
    def plain(i, text):
        w = words(text)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(g)
        covered = {k + j for k, x in enumerate(g) if n[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)

    got = quality_rules.quality(docs)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag(got.select(*cols).collect()) == bag(plain(r[0], r[1]) for r in rows)
    assert quality_rules.quality(no_docs).count() == 0


def test_quality_model_is_em_over_all_documents(docs):
    counted = quality_rules.features(docs)
    model = quality_rules.fit_rules(counted)
    conditions = [quality_rules.votes(r).alias(r.name) for r in quality_rules.RULES]
    votes = [tuple(map(int, r)) for r in counted.select(*conditions).collect()]
    prior, accuracy = 0.5, [0.7] * len(conditions)
    for _ in range(50):  # one document at a time
        post = []
        for v in votes:
            good, bad = prior, 1 - prior
            for x, a in zip(v, accuracy, strict=True):
                good *= {1: a, -1: 1 - a, 0: 1}[x]
                bad *= {1: 1 - a, -1: a, 0: 1}[x]
            post.append(good / (good + bad))
        prior = min(max(sum(post) / len(post), 0.5), 0.99)
        for j in range(len(accuracy)):
            cast = [(v[j], p) for v, p in zip(votes, post, strict=True) if v[j]]
            accuracy[j] = min(max(sum(p if x > 0 else 1 - p for x, p in cast) / len(cast), 0.55), 0.99) if cast else 0.7
    assert math.isclose(model.prior, prior, rel_tol=1e-9)
    assert np.allclose(model.accuracy, accuracy)
    judged = quality_rules.judge(counted, model).select(*conditions, "quality_probability", "base_failed", "kept").collect()
    for r in judged:
        p = model.posterior(r[: len(conditions)])
        assert math.isclose(p, r["quality_probability"], rel_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_substring_removal(docs, rows, no_docs):
    texts = [words(r[1]) for r in rows]
    starts = defaultdict(list)
    for d, w in enumerate(texts):
        for p in range(len(w) - 34):
            starts[tuple(w[p : p + 35])].append((d, p))
    gone = defaultdict(set)
    for at in starts.values():
        if len(at) > 1:
            for d, p in at:
                gone[d] |= set(range(p, p + 35))
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    expected = bag((r[0], len(gone[d]), sha([x for k, x in enumerate(w) if k not in gone[d]])) for d, (r, w) in enumerate(zip(rows, texts, strict=True)) if gone[d])
    lost = substring_dedup.repeats(docs)
    joined = docs.select("doc_id", *[c.alias(f"_k{i}") for i, c in enumerate(substring_dedup.row_keys())]).join(lost.toDF("_k0", "_k1", *lost.columns[2:]), ["_k0", "_k1"])
    assert bag(joined.select("doc_id", "n_removed", "kept_sha256").collect()) == expected
    for r in joined.collect():
        assert sha(words(r["kept_text"])) == r["kept_sha256"]
    assert substring_dedup.repeats(no_docs).count() == 0


def test_substring_stage_keeps_columns(spark, docs):
    out = substring_dedup.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    lost = {(r["row"], r["row2"]): r["kept_text"] for r in substring_dedup.repeats(docs).collect()}
    keyed = docs.select("doc_id", "text", *[c.alias(f"_k{i}") for i, c in enumerate(substring_dedup.row_keys())])
    expected = Counter((r["doc_id"], lost.get((r["_k0"], r["_k1"]), r["text"])) for r in keyed.collect())
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)


def test_levels_and_choices():
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(9) == [9] and substring_dedup.levels(100) == [13, 25, 50, 100]
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    w[120:160] = w[20:60]  # a passage that repeats
    starts, picks = substring_dedup.choices(w, [9, 18, 35])
    assert [len(p) for p in picks] == [len(starts[1]), len(starts[2])] and starts[2].tolist() == list(range(166))
    for k, (upper, lower) in enumerate(((18, 9), (35, 18))):
        assert ((picks[k] >= starts[k + 1]) & (picks[k] + lower <= starts[k + 1] + upper)).all() and set(picks[k]) == set(starts[k])
    assert {x + 100 for x in picks[1][20:26].tolist()} == set(picks[1][120:126].tolist())  # equal windows choose alike
    assert len(starts[0]) <= len(starts[1]) < 40


def test_windows_of_several_texts_at_once():
    """op3: every text was hashed by itself, word by word of a window, and cut word by word."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1 << 60, n, dtype=np.uint64) for n in (60, 3, 0, 35, 90, 34)]
    w, ends = np.concatenate(texts), np.cumsum([len(x) for x in texts])
    begins = ends - [len(x) for x in texts]
    sure = np.concatenate([b + np.arange(max(len(x) - 34, 0)) for b, x in zip(begins, texts, strict=True)])
    starts, picks = substring_dedup.choices(w, [9, 18, 35], sure)
    alone = [substring_dedup.choices(x, [9, 18, 35]) for x in texts]
    for k in range(3):
        assert starts[k].tolist() == [b + i for b, (s, _) in zip(begins, alone, strict=True) for i in s[k]]
    for k in range(2):
        assert picks[k].tolist() == [b + i for b, (_, p) in zip(begins, alone, strict=True) for i in p[k]]
    base = 0x9E3779B97F4A7C15
    for n in (1, 2, 9, 18, 35):
        plain = np.array([sum(int(x) * pow(base, j, 1 << 64) for j, x in enumerate(w[i : i + n])) % (1 << 64) for i in range(len(w) - n + 1)], dtype=np.uint64)
        assert (substring_dedup.window_hashes(w, n) == substring_dedup.mix(plain)).all()
    cut = lambda text, gone: substring_dedup._without(text.encode(), np.array(gone, dtype=bool))
    assert cut(" \ta  b\n\nc\x85d e ", [0, 1, 0, 0]) == "a\n\nc\x85d e" and cut(" a  b c ", [1, 1, 0]) == "c" and cut("a b", [1, 1]) == "" and cut("a\n b ", [0, 0]) == "a\n b"


def test_nothing_repeats(spark):
    df = spark.createDataFrame([(i, " ".join(f"a{i}_{k}" for k in range(50))) for i in range(9)], "doc_id long, text string")
    assert substring_dedup.repeats(df).count() == 0


def _shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(docs, rows, percent):
    sets = [_shingles(r[1]) for r in rows]
    named = [k for k, r in enumerate(rows) if r[0] is not None]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:  # rows without an id link like others
                root[find(a)] = find(b)
    least = {}
    for k in named:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    expected = []
    for k, r in enumerate(rows):
        c = least.get(find(k)) if sets[k] else r[0]
        c = r[0] if not sets[k] else c
        expected.append((r[0], len(sets[k]), c, r[0] == c))
    got = near_duplicates.near_duplicates(docs, percent)
    assert bag(got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == bag(expected)


def test_near_duplicates_in_blocks(docs, monkeypatch):
    whole = bag(near_duplicates.near_duplicates(docs).collect())
    monkeypatch.setattr(near_duplicates, "BLOCK_ROWS", 2)
    assert bag(near_duplicates.near_duplicates(docs).collect()) == whole
    monkeypatch.setattr(near_duplicates, "ROUNDS", 0)  # no centres: all pairs of every bucket
    assert bag(near_duplicates.near_duplicates(docs).collect()) == whole


def test_near_duplicates_of_nothing(no_docs):
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_link_matrix_equals_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 120, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(120) < rng.random() * 0.15, rng.integers(0, 1 << 60, 120, dtype=np.uint64), base)) for _ in range(40)]
    pairs = {(j, i) for i in range(40) for j in range(i) if near_duplicates.jaccard_links(sets[j], sets[i], 85)}
    left = np.ones(40, dtype=bool)
    assert set(near_duplicates._links(sets, left, 85)) == pairs
    left[20:] = False
    across = {tuple(sorted(p)) for p in near_duplicates._links(sets, left, 85)}
    assert across == {(a, b) for a, b in pairs if a < 20 <= b}


def test_super_min_hash_estimates():
    from tessera.llm.superminhash import signature

    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64)
            a, b = np.unique(x[: n + n // 2]), np.unique(x[n // 2 :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((signature(a, 100) == signature(b, 100)).mean() - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    assert len(set(signature(np.array([7], dtype=np.uint64), 100).tolist())) == 100


def test_bpe_is_the_library(docs, rows, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    expected = []
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert bag(bpe.digests(docs, path).collect()) == bag(expected)
    assert bpe.tokenised(no_docs, path).count() == 0


def test_bpe_on_strange_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    lib.no_truncation()
    rng = random.Random(2)
    points = lambda: chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x250, 0xD7FF), rng.randint(0xE000, 0x1FFFF), 32, 39, 115]))
    texts = ["".join(points() for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("aeinst") for _ in range(rng.randint(1, 70))) for _ in range(800)] + ["aaaaaaaaaaa", "Σίσυφος ΣΑΣ", "<|endoftext|>a<|startoftext|>"]
    for mine, theirs in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine == theirs.ids
        assert own.decode(mine) == lib.decode(theirs.ids, skip_special_tokens=False)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    n_words = np.array([3, 0, 7, 1, 5])
    scores = rng.normal(size=(16, 3)) * 3
    path = language_id.viterbi(scores, n_words, 2.0)
    value = lambda s, p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    at = 0
    for n in n_words:
        if n:
            best = max(value(scores[at : at + n], p) for p in np.ndindex(*[3] * n))
            assert math.isclose(value(scores[at : at + n], path[at : at + n].tolist()), best)
        at += n


def test_language_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = language_id.identify(docs, language_id._model(docs), keep=("lang",)).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    for r in out:
        at = 0
        for s in r["spans"]:
            assert s["first_word"] == at
            at += s["n_words"]
        best = Counter()
        for s in r["spans"]:
            best[s["lang"]] += s["n_words"]
        assert not at or math.isclose(max(best.values()) / at, r["score"])


def test_language_of_odd_texts(docs, rows, no_docs):
    out = language_id.identify(docs, language_id._model(docs))
    got = Counter((r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in out.collect())
    no_letter = lambda t: not any(c.isalpha() for c in t or "")
    assert got == Counter((r[0], no_letter(r[1]), no_letter(r[1])) for r in rows)
    assert language_id.identify(no_docs, language_id._model(no_docs)).count() == 0
    nothing = language_id.identify(docs, language_id._model(no_docs))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_script_narrows():
    counts = np.zeros((2, language_id.BUCKETS + len(language_id.NAMES)), dtype=np.int64)
    counts[0, language_id.BUCKETS + language_id.NAMES.index("latin")] = 100
    counts[1, language_id.BUCKETS + language_id.NAMES.index("cyrillic")] = 100
    model = language_id.Model(["en", "ru"], counts, 12.0, 0.01)
    langs, _, spans = language_id.label(["hello there", "привет вам", "hello привет"], model)
    assert langs[:2] == ["en", "ru"] and [s["lang"] for s in spans[2]] == ["en", "ru"]


def test_packing(docs, rows, no_docs):
    out = packing.pack(docs, n_buckets=3, token_budget=500, lane_rows=5)
    got = out.collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    seats = [(r["bucket"], r["lane"], r["batch"], r["place"]) for r in got]
    assert len(set(seats)) == len(seats)
    size = Counter(s[:3] for s in seats)
    for r in got:
        assert r["n_tokens"] + r["padding"] == r["bucket_length"] and r["padding"] >= 0
        n = size[r["bucket"], r["lane"], r["batch"]]
        assert n == 1 or n * r["bucket_length"] <= 500
    assert packing.pack(no_docs).count() == 0


def test_packing_boundaries_are_optimal():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        histogram = [(x, rng.randint(1, 20)) for x in lengths]
        k = rng.randint(1, 4)
        cost = lambda ends: sum(n * next(e for e in ends if e >= x) for x, n in histogram)
        best = min(cost((*c, lengths[-1])) for j in range(k) for c in itertools.combinations(lengths[:-1], j))
        ends = packing.boundaries(histogram, k)
        assert len(ends) <= k and cost(ends) == best


def test_packing_lengths_are_exact(spark):
    """Lengths over 64 words, where a rounded histogram misses the optimum."""
    two = spark.createDataFrame([(i, "w " * (65 if i < 100 else 250)) for i in range(200)], "doc_id long, text string")
    got = packing.pack(two).collect()
    assert {(r["n_tokens"], r["bucket_length"]) for r in got} == {(65, 65), (250, 250)} and sum(r["padding"] for r in got) == 0
    rng = np.random.default_rng(8)
    lengths = np.unique(rng.integers(65, 5000, 300)).tolist()
    histogram = [(x, int(n)) for x, n in zip(lengths, rng.integers(1, 50, len(lengths)), strict=True)]
    cost = [0.0] + [math.inf] * len(lengths)  # every split tried
    for _ in range(5):
        cost = [math.inf] + [min(cost[k] + sum(n for _, n in histogram[k:i]) * lengths[i - 1] for k in range(i)) for i in range(1, len(lengths) + 1)]
    ends = packing.boundaries(histogram, 5)
    assert sum(n * next(e for e in ends if e >= x) for x, n in histogram) == cost[-1]


def test_license_scan(docs, rows, no_docs):
    sets = {n: set(license_scan.bigrams_of(t)) for n, t in license_scan.TEMPLATES.items()}
    expected = []
    for r in rows:
        plain = re.sub(r"[^\w\n]+|_", " ", (r[1] or "").lower())
        lines = plain.split("\n")
        for k, line in ([(0, plain)] if len(lines) > 1 else []) + list(enumerate(lines, 1)):
            w = line.split()
            b = {f"{x} {y}" for x, y in zip(w, w[1:], strict=False)}
            scores = [(-2 * len(b & s) / (len(b) + len(s)), n) for n, s in sets.items()]
            score, name = min(scores)
            if b and -score >= 0.8:
                expected.append((r[0], k, name, len(b), len(b & sets[name])))
    got = license_scan.scan(docs)
    assert bag(got.select("doc_id", "segment", "license", "n_bigrams", "n_shared").collect()) == bag(expected)
    assert len(expected) >= 2 and license_scan.scan(no_docs).count() == 0


def test_license_windows(spark):
    """Wrapped headers and notices inside a line, in a long text."""
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    gpl = license_scan.TEMPLATES["gpl-3.0-notice"].split()
    header = "\n".join("# " + " ".join(gpl[i : i + 11]) for i in range(0, len(gpl), 11))
    inline = "This library was written in 2020. Released under the MIT License. See the file for details."
    mit = license_scan.TEMPLATES["mit-permission"]
    texts = [
        f"{prose(700)}\n{prose(9)}\n{header}\n#\nimport os\n{prose(900)}",
        inline,
        f"{prose(400)}\n{inline} {prose(300)}\n{header} {prose(20)}\n{header}",
        f"{prose(60)}\n{mit} All rights reserved.",
        f"{prose(30)}\nReleased under the MIT License.\n{prose(30)}",
        prose(3000),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.scan(df).select("doc_id", "segment", "license", "n_bigrams", "n_shared", "dice").collect()
    full = (len(license_scan.bigrams_of(license_scan.TEMPLATES["gpl-3.0-notice"])),) * 2
    five = -(-len(gpl) // 11)
    size = len(license_scan.bigrams_of(mit))
    assert {tuple(r)[:5] for r in got} == {
        (0, 3, "gpl-3.0-notice", *full), (1, 1, "mit", 4, 4), (2, 2, "mit", 4, 4), (2, 3, "gpl-3.0-notice", *full), (2, 3 + five, "gpl-3.0-notice", *full),
        (3, 2, "mit-permission", size + 3, size), (3, 2, "all-rights-reserved", 2, 2), (4, 2, "mit", 4, 4),
    }
    assert len(got) == 8 and min(r["dice"] for r in got) > 0.9


def test_complete_licenses(spark):
    """Whole licences, wrapped anew, alone and inside a long text."""
    import textwrap

    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    wrapped = lambda t, n: "\n\n".join(textwrap.fill(x, n) for x in t.split("\n\n"))
    names = sorted(license_scan.TEXTS)
    texts = [f"Copyright (c) 2020 Somebody\n\n{wrapped(license_scan.TEXTS[n], 66)}" for n in names]
    texts += [f"{prose(500)}\n{wrapped(license_scan.TEXTS[n], 90)}\n{prose(500)}" for n in names]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a line that is a notice by itself keeps its row beside the licence's
    got = [r for r in license_scan.scan(df).collect() if r["license"] in license_scan.TEXTS]
    assert len(names) == 12 and sorted((r["doc_id"], r["license"]) for r in got) == list(enumerate(names * 2))
    assert all(r["dice"] > 0.95 for r in got)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        slots = token_shards.feistel(np.arange(n), n, key=9)
        assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards.feistel(np.arange(1000), 1000, key=1) != token_shards.feistel(np.arange(1000), 1000, key=2)).mean() > 0.9


def test_shards_read_back(spark, docs, rows, no_docs):
    import public_tokenizers as P

    path, length, per_shard, end = P.path("byte_bpe_50k.tiktoken"), 64, 16, 50256
    slotted, total = token_shards.with_slots(token_shards.sequences(docs, path, P.PATTERN, length, group_bytes=30_000))
    assert slotted.select("group").distinct().count() > 1
    from tessera.llm.common import fresh_path

    folder = fresh_path(spark, "test-shards")
    token_shards.write_shards(slotted, folder, total, length, per_shard)
    enc = token_shards._encoding(path, P.PATTERN)
    at = {s * per_shard + r["record"]: r["ids"] for s in range(-(-total // per_shard)) for r in token_shards.read_shard(spark, folder, s, 0, length).collect()}
    assert sorted(at) == list(range(total))
    # sequences in the order of their numbers hold the texts one after another
    placed = slotted.orderBy("group", "place").collect()
    assert [r["slot"] for r in placed] == token_shards.feistel(np.arange(total), total).tolist()
    stream = [x for r in placed for x in at[r["slot"]][: r["n_tokens"]]]
    texts, now = Counter(), []
    for x in stream:
        now.append(x)
        if x == end:
            texts[tuple(now)] += 1
            now = []
    assert not now and texts == Counter((*enc.encode_ordinary(r[1] or ""), end) for r in rows)
    assert all(at[r["slot"]][r["n_tokens"] :] == [end] * (length - r["n_tokens"]) for r in placed)
    assert sum(r["n_tokens"] < length for r in placed) <= len({r["group"] for r in placed})
    by_id = {r[0]: enc.encode_ordinary(r[1] or "") for r in rows}
    assert {i for r in placed for i in r["doc_ids"]} == set(by_id)
    for r in placed:  # a sequence inside one text is a part of it
        if len(r["doc_ids"]) == 1 and r["doc_ids"][0] is not None and end not in at[r["slot"]]:
            whole, part = by_id[r["doc_ids"][0]], at[r["slot"]]
            assert any(whole[k : k + length] == part for k in range(len(whole) - length + 1))
    rest = token_shards.read_shard(spark, folder, 0, 5, length).orderBy("record").collect()
    assert [r["ids"] for r in rest] == [at[k] for k in range(5, 5 + len(rest))]
    said = token_shards.manifest(spark, folder)
    assert (said["total"], said["length"], said["per_shard"], said["stride"]) == (total, length, per_shard, 2 * length + 2)
    for start in (0, 5, per_shard + 3, total - 1, total):  # resumed anywhere
        assert [(k, x.tolist()) for k, x in token_shards.records_from(spark, folder, start, 7)] == [(k, at[k]) for k in range(start, total)]
    # the order is that of the rows and the key, whatever the splits
    again, _ = token_shards.with_slots(token_shards.sequences(docs.orderBy("text").repartition(5), path, P.PATTERN, length, group_bytes=30_000))
    assert Counter((r["slot"], bytes(r["ids"])) for r in again.collect()) == Counter((r["slot"], bytes(r["ids"])) for r in slotted.collect())
    none, n = token_shards.with_slots(token_shards.sequences(no_docs, path, P.PATTERN, length))
    assert n == 0 and none.count() == 0
