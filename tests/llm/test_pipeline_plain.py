"""The pipeline's stages and registered queries against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import language_id, quality_rules, registry

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _counts(text):
    """The counts of one text in the names of the rules' conditions."""
    t, w = text or "", words(text)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(g)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    some = lambda chars: sum(c in chars for c in t)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": some("#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({k + j for k, x in enumerate(g) if n[x] > 1 for j in range(3)}), "n_upper": some("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_marks": some(".,;:!?"),
    }


def _holds(condition, counts):
    """A rule's condition, read as Python."""
    plain = re.sub(r"(\w+) between (.+?) and (.+)$", r"(\2) <= \1 <= (\3)", condition).replace(" = ", " == ")
    return eval(plain, {}, counts)  # noqa: S307


def _good(texts):
    counts = [_counts(t) for t in texts]
    votes = [tuple(-1 if _holds(r.bad, c) else 1 if _holds(r.good, c) else 0 for r in quality_rules.RULES) for c in counts]
    model = quality_rules.fit(sorted(Counter(votes).items()))
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]
    return [not f and model.posterior(v) >= 0.5 for f, v in zip(failed, votes, strict=True)]


def _first_of_groups(rows, percent):
    """Rows (id, text) whose id is the least of their group of near duplicates."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [r for k, r in enumerate(rows) if r[0] == least[find(k)]]


def _without_repeats(rows, length=35):
    starts, out = defaultdict(list), []
    for d, (_, t) in enumerate(rows):
        w = words(t)
        for p in range(len(w) - length + 1):
            starts[tuple(w[p : p + length])].append((d, p))
    gone = defaultdict(set)
    for at in starts.values():
        if len(at) > 1:
            for d, p in at:
                gone[d] |= set(range(p, p + length))
    for d, (i, t) in enumerate(rows):
        out.append((i, [x for k, x in enumerate(words(t)) if k not in gone[d]]))
    return out


def test_pipeline_is_its_stages_in_plain_python(spark, documents):
    import corpus_pipeline

    paths = corpus_pipeline.run_stages(spark, SF)
    assert list(paths) == [n for n, _ in corpus_pipeline.STAGES]
    told = {n: spark.read.parquet(p) for n, p in paths.items()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]

    langs, shares, _ = language_id.label([t or "" for _, t in rows], language_id._model(documents))
    rows = [r for r, lang, share in zip(rows, langs, shares, strict=True) if lang != "und" and share >= language_id.MIN_SHARE]
    assert Counter(map(tuple, told["language_id"].select("doc_id", "text").collect())) == Counter(rows)

    rows = [r for r, good in zip(rows, _good([t for _, t in rows]), strict=True) if good]
    assert Counter(map(tuple, told["quality_rules"].select("doc_id", "text").collect())) == Counter(rows)

    rows = _first_of_groups(rows, 80)
    assert Counter(map(tuple, told["minhash_near_dedup"].select("doc_id", "text").collect())) == Counter(rows)

    cut = _without_repeats(rows)
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in told["substring_dedup"].collect()) == Counter((i, tuple(w)) for i, w in cut)
    assert len(cut) < documents.count() and sum(len(w) for _, w in cut) < sum(len(words(t)) for _, t in rows)

    seats = told["packing"].collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in seats) == Counter((i, len(w)) for i, w in cut)
    assert sum(r["padding"] for r in seats) == _least_padding([len(w) for _, w in cut], 8)


def _least_padding(lengths, buckets):
    """The least padding of any choice of bucket ends, by trying every split."""
    sizes = sorted(Counter(max(x, 1) for x in lengths).items())
    cost = [0.0] + [math.inf] * len(sizes)
    best = math.inf
    total = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    for _ in range(buckets):
        cost = [math.inf] + [min(cost[k] + (total[i] - total[k]) * sizes[i - 1][0] for k in range(i)) for i in range(1, len(sizes) + 1)]
        best = min(best, cost[-1])
    return best - sum(lengths)


def test_op1_returns_what_its_contract_says(spark, documents):
    out = registry.queries()["op1_quality_rules"](spark, SF)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rows = documents.select("doc_id", "text").collect()
    counts = [_counts(r["text"]) for r in rows]
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for c in counts]
    good = _good([r["text"] for r in rows])
    want = [(r["doc_id"], *(c[k] for k in out.columns[1:6]), f, g) for r, c, f, g in zip(rows, counts, failed, good, strict=True)]
    assert Counter(tuple(r)[:8] for r in out.collect()) == Counter(want)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"]: g for r, g in zip(rows, good, strict=True)}
    clean = [kept[i] for i, q in labels.items() if q == 1 and i in kept]
    assert sum(clean) / len(clean) > 0.8  # documents labelled as good stay


def test_op8_pads_the_least(spark, documents):
    seats = registry.queries()["op8_packing"](spark, SF).collect()
    lengths = [len(words(r["text"])) for r in documents.collect()]
    assert sorted(r["n_tokens"] for r in seats) == sorted(lengths)
    assert sum(r["padding"] for r in seats) == _least_padding(lengths, 8)


def test_op10_columns_and_held_out(spark, documents):
    out = registry.queries()["op10_language_id"](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows, lang = out.collect(), {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    told = [(lang[r["doc_id"]], r["lang_pred"]) for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert len(rows) == len(lang) and sum(a == b for a, b in told) / len(told) > 0.95


def test_op6_and_op7_registered(spark, documents):
    places = registry.queries()["op6_token_shards"](spark, SF).collect()
    assert sorted(r["slot"] for r in places) == list(range(len(places)))
    assert all(r["offset"] == r["slot"] % 8192 * 1026 and r["folder"].endswith(f"/shard={r['slot'] // 8192}") for r in places)
    out = registry.queries()["op7_bpe"](spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == documents.count()
    nothing = hashlib.sha256(b"").hexdigest()
    empty = {r["doc_id"] for r in documents.collect() if not r["text"]}
    assert {r["doc_id"] for r in out.collect() if r["ids_sha256"] == nothing} >= empty


def test_spans_of_texts_mixed_within_one_script(spark, documents):
    """Halves in two languages of one script: the words of each half get its language."""
    model = language_id._model(documents)
    by = defaultdict(list)
    for r in documents.collect():
        if r["lang"] and r["text"] and 60 <= len(words(r["text"])) <= 400:
            by[r["lang"]].append(" ".join(words(r["text"])[:60]))
    latin = [x for x in sorted(by) if all(c < "Ͱ" or not c.isalpha() for c in by[x][0])]
    right = total = 0
    for a in latin:
        for b in latin:
            if a != b:
                for x, y in zip(by[a][:3], by[b][:3], strict=False):
                    n, m = (sum(len(s) for s in [re.findall(r"[^\W\d_]+", t)]) for t in (x, y))
                    spans = language_id.label([f"{x} {y}"], model)[2][0]
                    said = [s["lang"] for s in spans for _ in range(s["n_words"])]
                    true = ([a] * n + [b] * m)[: len(said)]
                    right += sum(p == q for p, q in zip(said, true, strict=False))
                    total += len(said)
    assert len(latin) >= 2 and right / total > 0.9
