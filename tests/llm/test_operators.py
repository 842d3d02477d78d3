"""Every operator against a plain version of itself, on rows with every odd case, and on no rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import common, decontaminate, exact, labelled, mixing, ngram_join, quality, repeats, suffixes, tokens, toxicity, warc

P = pytest.importorskip("public_tokenizers")


def got(df):
    return [r.asDict() for r in df.collect()]


def same(rows, wanted):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(map(key, rows)) == sorted(map(key, wanted))


def test_token_counts(spark, docs, none, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    cache = common.new_path(spark, "cache")
    wanted = [{"doc_id": i, "n_bytes": len((x or "").encode()), "n_tokens": (n := len(t.encode(x or "", add_special_tokens=False))), "over_limit": n > 2048} for i, x in texts]
    same(got(tokens.token_counts(docs, path, cache)), wanted)
    before = spark.read.parquet(cache).count()
    same(got(tokens.token_counts(docs, path, cache)), wanted)
    assert spark.read.parquet(cache).count() == before == len({re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in texts})
    assert got(tokens.token_counts(none, path, common.new_path(spark, "cache"))) == []


def test_token_counts_of_other_tokenizers_and_strange_words(spark):
    from tokenizers import Tokenizer

    odd = ["don't I'LL 12345 ...!?", "naïve café é  x y", "İstanbul ΟΔΟΣ ß", "<|startoftext|>a<|endoftext|>", "‍﻿\x1c\x85", "日本語 テキスト", "a\x00b"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = Tokenizer.from_file(P.path(name))
        found = {r["doc_id"]: r["n_tokens"] for r in got(tokens.token_counts(df, P.path(name), common.new_path(spark, "cache")))}
        assert found == {k: len(t.encode(x, add_special_tokens=False)) for k, x in enumerate(odd)}


def plain_copies(texts):
    groups = defaultdict(list)
    for i, x in texts:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", x or "")].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = (min(known) if known else None), True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append({"doc_id": i, "keep_id": keep, "group_size": len(ids), "kept": first, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()})
            first = False
    return out


def test_exact_copies(docs, none, texts):
    same(got(exact.exact_copies(docs)), plain_copies(texts))
    assert got(exact.exact_copies(none)) == []


def test_exact_copies_compare_bytes_where_digests_agree(docs, texts):
    weak = lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))
    same(got(exact.exact_copies(docs, weak)), plain_copies(texts))


@pytest.mark.parametrize("digest", [exact.sha256, lambda text: F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))])
def test_exact_copies_of_a_second_batch_meet_the_first(spark, texts, digest):
    state, parts = common.new_path(spark, "kept-state"), (texts[::2], texts[1::2], [(900, None), (1, "new"), (901, "new"), (902, "one")])
    seen, sizes = {}, Counter()
    for part in parts:
        norms = [re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in part]
        sizes.update(norms)
        first = {}
        for (i, _), norm in sorted(zip(part, norms, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
            first.setdefault(norm, i)
        wanted = []
        left = {norm for norm in first if norm not in seen}
        for (i, _), norm in sorted(zip(part, norms, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
            wanted.append({"doc_id": i, "keep_id": seen.get(norm, first[norm]), "group_size": sizes[norm], "kept": norm in left, "text_sha256": hashlib.sha256(norm.encode()).hexdigest()})
            left.discard(norm)
        seen = first | seen
        df = spark.createDataFrame(part, "doc_id long, text string").repartition(2)
        same(got(exact.exact_copies(df, digest, state_path=state)), wanted)


def test_a_hot_text_is_joined_where_its_rows_lie(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot text").otherwise(F.concat(F.lit("x"), (F.col("id") % 700).cast("string"))).alias("text"))
    texts = [tuple(r) for r in df.collect()]
    same(got(exact.exact_copies(df)), plain_copies(texts))


def test_without_copies_keeps_one_row_of_each_group(docs, none, texts):
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", x or "") for _, x in texts})
    assert exact.without_copies(none).count() == 0


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_similar_components(docs, none, texts):
    own = defaultdict(set)
    for i, x in texts:
        own[i].add(frozenset(sets_of(x)))
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in own if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= 80 * len(x | y) for x in own[a] for y in own[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    found = got(ngram_join.similar_components(docs))
    by_set = {s: find(i) for i in ids for s in own[i] if s}
    wanted = [{"doc_id": i, "n_shingles": len(s := frozenset(sets_of(x))), "component_id": find(i) if i is not None else by_set.get(s)} for i, x in texts]
    same(found, wanted)
    assert got(ngram_join.similar_components(none)) == []
    left = ngram_join.one_per_component(docs)
    assert left.columns == docs.columns and left.filter("doc_id is not null").select("doc_id").distinct().count() == len({find(i) for i in ids})


def test_prefix_keys_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    for n in (4, 5, 8, 20, 60, 300, 900):
        for often in (0.0, 0.5, 1.0):
            for _ in range(6):
                base = np.unique(rng.integers(1, 2**63, n * 2, dtype=np.int64)).astype(np.uint64)[:n]
                extra = np.unique(rng.integers(1, 2**63, n, dtype=np.int64)).astype(np.uint64)
                drop = int(rng.integers(0, max(1, n // 9) + 1))
                add = int(rng.integers(0, max(1, n // 9) + 1))
                other = np.concatenate((np.delete(base, rng.choice(n, drop, replace=False)), extra[:add]))
                if 100 * (n - drop) < 80 * (n + add):
                    continue
                df = {int(t): (50 if rng.random() < often else 2) for t in np.concatenate((base, extra))}
                keys = []
                for s in (base, other):
                    order = sorted(s.tolist(), key=lambda t: (df[t], t))
                    keys.append(set(ngram_join.prefix_keys(len(s), np.array(order, np.uint64), np.array([df[t] for t in order], np.uint32)).tolist()))
                assert keys[0] & keys[1], (n, often, drop, add)


@pytest.mark.parametrize("percent", [20, 40, 60, 75, 80, 90])
def test_prefix_keys_of_other_percents_lose_no_similar_pair(percent):
    for n in (2, 3, 6, 9, 30, 100, 240):
        for m in sorted({n, n + 1, (n * 100 // percent + n) // 2, n * 100 // percent}):
            if 100 * n < percent * m:
                continue
            for seed in range(4):
                rng = np.random.default_rng(seed)
                tokens = np.unique(rng.integers(1, 2**63, m + 5, dtype=np.int64)).astype(np.uint64)
                big = rng.permutation(tokens)[:m]
                keys = [set(ngram_join.prefix_keys(len(s), np.sort(s), np.full(len(s), 50, np.uint32), percent).tolist()) for s in (big, big[:n])]
                assert keys[0] & keys[1], (n, m, seed)


def test_frequent_tokens_and_blocks(spark, docs, texts, monkeypatch):
    plain = got(ngram_join.similar_components(docs))
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 500)
    same(got(ngram_join.similar_components(docs)), plain)


def test_contaminated(spark, docs, none, texts):
    passage = texts[20][1].split()[60:170]
    items = [(1, " ".join(passage[10:60])), (2, "never seen words in any text here"), (3, None), (4, ""), (5, "A b C"), (5, "A b C"), (6, " ".join(passage[:30]) + " but other words"), (None, "a b c d")]
    held = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, need int")
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    wanted = []
    for i, x in texts:
        for item, t in dict.fromkeys(items):
            w, q = low(x), low(t)
            k = min(len(q), 5)
            if k:
                a = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)}
                s = len(a & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
                if 100 * s >= 80 * len(a):
                    wanted.append({"doc_id": i, "item_id": item, "n_item_shingles": len(a), "n_shared": s})
    assert any(r["item_id"] == 1 for r in wanted) and any(r["item_id"] == 5 for r in wanted)
    same(got(decontaminate.contaminated(docs, held)), wanted)
    assert got(decontaminate.contaminated(none, held)) == [] == got(decontaminate.contaminated(docs, held.limit(0)))
    left = decontaminate.clean_documents(docs, held)
    bad = {r["doc_id"] for r in wanted}
    assert left.columns == docs.columns and left.filter("doc_id is not null").count() == sum(i is not None and i not in bad for i, _ in texts)


def test_mixture(docs, none, texts):
    rows = got(mixing.mixture_report(docs))
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    source = lambda i: f"s{(i or 0) % 3}" if i is None or i % 5 else None
    sums = Counter()
    for i, x in texts:
        sums[source(i)] += size(x)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(sums.values()))
    while True:
        share = {s: weight[s] * rest / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sums[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sums[s]
            rest -= target[s]
            open_.remove(s)
    target |= share
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted((i is None, i or 0, size(x)) for i, x in texts)
    for r in rows:
        s = source(r["doc_id"])
        assert r["source_size"] == sums[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    same(rows, got(mixing.mixture_report(docs)))
    assert got(mixing.mixture_report(none)) == []
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy"] and mixing.mix(none).count() == 0
    assert sum(size(r["text"]) for r in mixed.select("text").collect()) == sum(r["taken"] for r in rows)


def plain_repeats(texts, length):
    seen = Counter()
    for _, x in texts:
        b = (x or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    for i, x in texts:
        b = (x or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield {"doc_id": i, "n_bytes": len(b), "n_removed": int(gone.sum()), "n_spans": int((np.diff(gone.astype(int), prepend=0) == 1).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()}


@pytest.mark.parametrize("per_salt", [1024, 1])
def test_repeats(docs, none, texts, monkeypatch, per_salt):
    monkeypatch.setattr(repeats, "PER_SALT", per_salt)
    short = [(i, x) for i, x in texts if len(x or "") < 20_000]
    df = docs.filter("length(text) < 20000 or text is null")
    same(got(repeats.without_repeats(df).drop("shares_passage")), list(plain_repeats(short, 400)))
    assert got(repeats.without_repeats(none)) == []


def test_equal_hashes_of_unequal_bytes_remove_nothing(spark):
    """Two texts without a common 400-byte string, whose tails (a Thue-Morse string of two letters and its complement) have equal polynomial hashes."""
    morse = [bin(k).count("1") % 2 for k in range(256)]
    head = "".join(chr(97 + k * 7 % 26) + str(k) for k in range(80))[:144]
    tail = lambda one, two: "".join((one, two)[m] for m in morse)
    texts = [(1, head + tail("P", "q")), (2, head + tail("q", "P"))]
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    assert len(set(suffixes.classes(data, np.array([0, 400]), 400).tolist())) == 2
    rows = got(repeats.without_repeats(spark.createDataFrame([*texts, (3, head + tail("P", "P"))], "doc_id long, text string")))
    assert [r["n_removed"] for r in rows] == [0, 0, 0]


@pytest.mark.parametrize("memory", [1 << 20, 64])
def test_suffixes_in_order_with_common_prefixes(memory):
    rng = np.random.default_rng(3)
    for trial in range(60):
        t = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 120)), dtype=np.uint8)
        t = np.tile(t, 3) if trial % 3 == 0 else t
        raw = t.tobytes()
        order = suffixes.suffix_array(t, memory)
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        shared = suffixes.common_prefixes(t, order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
            k = int(shared[b])
            assert raw[a : a + k] == raw[b : b + k] and raw[a + k : a + k + 1] != raw[b + k : b + k + 1]
        at = np.arange(max(0, len(raw) - 8))
        which = suffixes.classes(t, at, 9, memory)
        by = {}
        assert all(by.setdefault(raw[k : k + 9], w) == w for k, w in zip(at.tolist(), which.tolist(), strict=True)) and len(by) == len(set(which.tolist()))


def test_queues_go_to_disk():
    queues = suffixes.Queues(memory=1000)
    rng = np.random.default_rng(1)
    wanted = defaultdict(list)
    for k in range(50):
        first, at = rng.integers(0, 5, 100, dtype=np.uint8), np.arange(100, dtype=np.int32) + 100 * k
        queues.push(first, at)
        for c, x in zip(first.tolist(), at.tolist(), strict=True):
            wanted[c].append(x)
    assert queues.spilled > 10_000 and queues.held <= 1000
    assert {c: queues.pop(c).tolist() for c in range(5)} == wanted and queues.pop(0) is None


def test_passages_of_over_fifty_words_are_found(spark, docs, texts):
    def runs(text, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    rng = np.random.default_rng(9)
    own = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 4)))) for _ in range(n))
    passages = [own(n) for n in (51, 52, 60, 44, 30)]
    more = [(1000 + k, f"{own(int(rng.integers(0, 60)))} {passages[k % 5]} {own(int(rng.integers(0, 60)))}") for k in range(60)] + [(1100, passages[0]), (1101, own(51)), (1102, own(200))]
    every = [(i, t) for i, t in texts if len(t or "") < 20_000] + more
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(4)
    found = defaultdict(list)
    for r in got(repeats.without_repeats(df)):
        found[r["doc_id"]].append(r["shares_passage"])
    long, short = Counter(x for _, t in every for x in runs(t, 51)), Counter(x for _, t in every for x in runs(t, 45))
    for i, t in every:
        if any(long[x] > 1 for x in runs(t, 51)):
            assert any(found[i]) if i is None else all(found[i])
        elif i is not None and not any(short[x] > 1 for x in runs(t, 45)):
            assert not any(found[i]), i
    assert sum(map(any, found.values())) > 36


def test_repeats_of_very_long_texts(docs, texts):
    r = {x["doc_id"]: x for x in got(repeats.without_repeats(docs))}
    n = len(texts[5][1])
    assert r[5]["n_removed"] == n == r[6]["n_removed"] and r[6]["n_spans"] == 1


def labels_of(spark, texts):
    rows = [(i, int("same" in (x or "")), int("same" in (x or ""))) for i, x in texts if i is not None]
    return spark.createDataFrame([*rows, (None, 1, 1), (7, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(k, f"plain words about item {k} and more of them", 0) if k % 2 else (k, f"word{k} " * 30 + "stupid clown idiot", 1) for k in range(400)]
    docs = spark.createDataFrame([(i, t, 1.5, True) for i, t, _ in rows], "doc_id long, text string, score double, held_out boolean")
    return docs, spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("scores,threshold", [(quality.quality_scores, 0.3), (toxicity.toxicity_scores, 0.5)])
def test_scores(spark, docs, none, texts, taught, scores, threshold):
    rows = got(scores(docs, labels_of(spark, texts)))
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert got(scores(none, labels_of(spark, texts))) == []
    assert {r["score"] for r in got(scores(docs, labels_of(spark, texts).limit(0)))} == {0.5}
    own = got(scores(*taught))
    assert np.mean([r["predicted"] == int(r["doc_id"] % 2 == 0) for r in own if r["held_out"]]) > 0.95


def test_held_out_labels_are_not_learned(spark, taught):
    docs, labels = taught
    ids = {r["doc_id"] for r in got(labelled.sample(docs, labels, "toxic"))}
    assert ids and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    assert labelled.sample(docs, labels, "toxic", 50).count() == 50


def test_good_documents_keep_their_columns(taught):
    docs, labels = taught
    left = quality.good_documents(docs, labels)
    assert left.columns == docs.columns and 150 < left.count() < 250


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    rows = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(600)]
    doc = np.concatenate([[k] * (1 + a + b) for k, (a, b) in enumerate(rows)])
    term = np.concatenate([[5, *([7] if a else []), *([9] if b else [])] for a, b in rows])
    y = np.array([float(a == b) for a, b in rows])
    m = toxicity.train(doc, term, y, epochs=80)
    assert m.w.size and np.mean((toxicity.forward(doc, m.place[term].clip(0), 600, m.w0, m.w, m.v)[0] > 0) == y) >= 0.5


def test_toxicity_learns_terms_that_tell_only_in_pairs():
    rng = np.random.default_rng(7)

    def texts(n):
        rows = [(rng.random() < 0.5, rng.random() < 0.5, np.unique(100 + (2000 ** rng.random(12)).astype(int))) for _ in range(n)]
        doc = np.concatenate([[k] * (a + b + len(c)) for k, (a, b, c) in enumerate(rows)])
        term = np.concatenate([[*([7] if a else []), *([9] if b else []), *c] for a, b, c in rows])
        return doc, term, np.array([float(a == b) for a, b, _ in rows])

    doc, term, y = texts(2000)
    m = toxicity.train(doc, term, y)
    assert set(np.flatnonzero(m.place >= 0)) == set(np.flatnonzero(np.bincount(term) >= toxicity.LEAST_ROWS))
    doc, term, y = texts(500)
    used = m.place[term] >= 0
    assert np.mean((toxicity.forward(doc[used], m.place[term[used]], 500, m.w0, m.w, m.v)[0] > 0) == y) > 0.95


def test_toxicity_pairs_by_the_machines_own_terms():
    rng = np.random.default_rng(0)
    rows = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(600)]
    doc = np.concatenate([[k] * (1 + a + b) for k, (a, b) in enumerate(rows)])
    term = np.concatenate([[5, *([7] if a else []), *([9] if b else [])] for a, b in rows])
    y = np.array([float(a == b) for a, b in rows])
    m = toxicity.train(doc, term, y, epochs=80)
    assert (m.place[[5, 7, 9]] >= 0).all()
    assert np.mean((toxicity.forward(doc, m.place[term], 600, m.w0, m.w, m.v)[0] > 0) == y) > 0.95


def test_word_vectors_and_pooling_against_plain_loops(spark):
    texts = ["the cat sat on THE mat !!", "a b", "", "the the the", "Grün 12,5 % x-y cat sat"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    place, sign = quality._index_vectors()
    total = np.zeros((quality.UNITS, quality.DIM))
    owned = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, word, shape = quality.units(raw, np.array([0, len(raw)]))
        owned.append((word, shape))
        for i in range(len(word)):
            for j in range(max(0, i - quality.WINDOW), min(len(word), i + quality.WINDOW + 1)):
                if i != j:
                    for own, other in ((word[i], word[j]), (word[i], shape[j]), (shape[i], shape[j])):
                        for k in range(quality.PLACES):
                            total[own, place[other, k]] += sign[other, k]
    wanted = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, wanted, atol=1e-5)
    raws = [t.encode() for t in texts]
    x = quality.pooled(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), vectors)
    for row, (word, shape) in zip(x, owned, strict=True):
        parts = [wanted[u].mean(0) if len(u) else np.zeros(quality.DIM) for u in (word, shape)]
        assert np.allclose(row, np.concatenate((*parts, [np.linalg.norm(p) for p in parts])), atol=1e-4)


def test_machine_scores_against_every_pair():
    rng = np.random.default_rng(6)
    texts = ["you are a clown and an idiot", "", "alpha beta", "clown clown CLOWN", "x" * 3]
    raws = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    doc, term = toxicity.distinct(*toxicity.terms(data, offsets))
    used = np.unique(term)[::2]
    place = np.full(toxicity.TERMS, -1, np.int32)
    place[used] = np.arange(len(used))
    machine = toxicity.Machine(place, 0.3, rng.normal(size=len(used)), rng.normal(size=(len(used), toxicity.FACTORS)))
    for k, score in enumerate(machine.score(data, offsets)):
        own = [place[t] for t in term[doc == k] if place[t] >= 0]
        pairs = sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(own) for b in own[i + 1 :])
        logit = machine.w0 + sum(machine.w[a] for a in own) + pairs / max(len(own), 1)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-6)


def test_learned_terms_are_bounded(taught, monkeypatch):
    docs, labels = taught
    monkeypatch.setattr(toxicity, "HELD_TERMS", 2000)
    seen = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda doc, term, y: seen.append((len(term), len(y))) or real(doc, term, y))
    toxicity.fit(docs, labels)
    assert 1000 < seen[0][0] <= 2000 and 0 < seen[0][1] < 300


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    assert quality.temperature(4 * z, y) == pytest.approx(4, rel=0.2)


def test_arc_forms_and_errors():
    one = warc.arc_head("a.arc", 1) + b"\n" + warc.arc_record(1, "http://a/ b", "20240102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhi\n\n") + b"\n"
    two = warc.arc_head("b.arc", 2) + b"\n" + warc.arc_record(2, "dns:a", "2024", "text/dns", b"") + b"\n"
    (a,), (b,) = list(warc.read_arc(one)), list(warc.read_arc(two))
    assert a.fields["url"] == "http://a/%20b" and bytes(a.block).endswith(b"hi\n\n") and b.fields["status"] == "200" and bytes(b.block) == b""
    assert warc.iso_date("20240102030405") == "2024-01-02T03:04:05Z" and warc.iso_date("2024") == "2024-01-01T00:00:00Z" and warc.iso_date("x") == "1970-01-01T00:00:00Z"
    for bad in (one[:-4], b"http://a 0 0 0 3\nabc", warc.arc_head("a", 1).replace(b"\n1 0", b"\n7 0")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    with pytest.raises(ValueError):
        list(warc.read_warc(warc.warc_record([("WARC-Type", "response")], b"abc")[:-1]))


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, none, least):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b c", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\n"), (6, "v", "z" * 100_000), (9, "w", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "m", "only"), (7, "q", "dup"), (7, "q", "dup")]
    df = spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in pages], "page_id long, url string, html string, digest string, offset long").repartition(3)
    rows = got(warc.round_trip(df, least))
    assert Counter((r["page_id"], r["payload_bytes"]) for r in rows) == Counter((i, len((h or "").encode())) for i, _, h in pages)
    best = defaultdict(lambda: -1)
    for i, _, h in pages:
        best[h or ""] = max(best[h or ""], -1 if i is None else i)
    digests = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in best}
    for r in rows:
        h = digests[r["payload_digest"]]
        if r["record_type"] == "revisit":
            assert r["refers_to"] == best[h] and len(h) >= least
        else:
            assert r["refers_to"] is None
    assert sum(r["record_type"] == "response" for r in rows) == len(best) + (least > 0)
    assert got(warc.round_trip(df.limit(0))) == []
