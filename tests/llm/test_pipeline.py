"""The pipeline's stages one after the other, each against a plain version of it on its own input, and on odd tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from loomline.llm.common import stage, table

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return row["doc_id"], row["text"], row["lang"], row["source"], row["n_chars"]


def plain_exact(rows):
    best = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    return list(best.values())


def shingles(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def plain_near(rows):
    sets = {r["doc_id"]: shingles(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def plain_clean(rows, items):
    def contains(text, item):
        w = WORD.findall(item.lower())
        n = min(5, len(w))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        held = WORD.findall(text.lower())
        there = {tuple(held[k : k + n]) for k in range(len(held) - n + 1)} if n else set()
        return bool(own) and 100 * len(own & there) >= 80 * len(own)

    return [r for r in rows if not any(contains(r["text"] or "", x["text"] or "") for x in items)]


def plain_mix(rows):
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r["source"]] += size[r["doc_id"]]
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(sums.values())
    while True:
        left = total - sum(3.0 * sums[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        share = {s: weight[s] * left / open_ for s in order if s not in capped}
        more = {s for s in share if share[s] > 3.0 * sums[s]}
        if not more:
            break
        capped |= more
    out = Counter()
    for r in rows:
        s = r["source"]
        rate = min(3.0, (3.0 * sums[s] if s in capped else share[s]) / sums[s]) if sums[s] else 0.0
        u = int(hashlib.md5(f"{r['doc_id']}:0".encode()).hexdigest()[:13], 16) / 2.0**52
        out[r["doc_id"]] = int(rate) + (u < rate - int(rate))
    return out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, function in pipeline.STAGES:
        before = docs
        docs = stage(function(spark, docs, SF), name)
        seen[name] = [r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()]
        assert docs.columns == columns or name == "source_mixing"
    assert list(seen) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    before, after = seen["quality_classifier"]
    left = {r["doc_id"] for r in after}
    good = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 1]
    assert sum(i in left for i in good) >= 0.97 * len(good) and sum(labels.get(i) == 0 for i in left) <= 3
    assert {key(r) for r in after} <= {key(r) for r in before}
    items = [r.asDict() for r in table(spark, SF, "benchmark").collect()]
    for name, plain in (("exact_dedup", plain_exact), ("ngram_jaccard_join", plain_near), ("benchmark_decontamination", lambda rows: plain_clean(rows, items))):
        before, after = seen[name]
        assert sorted(map(key, after), key=str) == sorted(map(key, plain(before)), key=str), name
    before, after = seen["source_mixing"]
    assert Counter(r["doc_id"] for r in after) == +plain_mix(before)
    assert all(sorted(r["mix_copy"] for r in after if r["doc_id"] == i) == list(range(1, n + 1)) for i, n in Counter(r["doc_id"] for r in after).items())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_tables(spark, docs, none, k):
    """Nulls in every column, empty and very long texts, copies, repeated rows, rows without an id, columns of clashing names, and no rows."""
    name, function = pipeline.STAGES[k]
    odd = docs.unionByName(spark.createDataFrame([(500 + j, None, None, None, None, None, None, None, None, None, None) for j in range(2)], docs.schema))
    left = function(spark, odd, SF)
    assert left.columns[: len(odd.columns)] == odd.columns
    before, after = ({tuple(r)[: len(odd.columns)] for r in df.collect()} for df in (odd, left))
    assert after <= before and after
    rest = function(spark, none, SF)
    assert rest.count() == 0 and rest.columns == left.columns
