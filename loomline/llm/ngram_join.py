"""N-gram Jaccard join on token-combination prefixes.

Documents are sets of word shingles (tokens here). Equal sets form one class. All tokens are put in one order, rarest
first, by their exact document frequency. Two sets with Jaccard similarity t or more share at least G + 1 tokens among
their first n - ceil(t n) + 1 + G tokens. Rare tokens of that prefix are index keys on their own. Frequent tokens are
dealt into G groups by hash, and the keys are the pairs within a group: G + 1 shared frequent tokens put two into one
group, so a key is shared. G grows with the size level of the sets, which keeps the number of pairs linear in the prefix.

Documents that share a key are candidates. Each key links its documents to its smallest one first; keys whose documents
are not all in one component after that are settled exactly, in blocks. Every link is verified on whole sets.

Token frequencies are summed from sorted runs of hashes that tasks send to hash slices; a token that a task holds often
is sent once with its count, so no slice receives all copies of a hot token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesgrams as bg
from .common import bound_batches, small, stage
from .components import components

WIDTH, PERCENT = 5, 80
#: Tokens in at least so many documents are frequent: keys are pairs of them.
FREQUENT = 32
#: Frequent tokens of a full prefix that share a group, about.
PER_GROUP = 8
#: Tokens and documents that a task sends at a time, tokens in a hash slice, documents in a block that is settled at once.
CHUNK_TOKENS, CHUNK_DOCS, SLICE_TOKENS, BLOCK = 2_000_000, 60_000, 2_000_000, 512
#: A token that a chunk holds so often is sent once, with its count.
OFTEN = 8
_MARK = 0xFFFF

U64 = np.uint64


def _sets(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, tokens, texts): the distinct tokens of each text, sorted by text and token."""
    for a, b, data, offsets in bg.chunks(column):
        w = bg.words(data, offsets)
        token, doc = bg.shingles(w.hash, w.doc, b - a, width)
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        yield a, b, token[first], doc[first]


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (size of the set) and two 64-bit sums that stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, token, doc in _sets(batch.column("text"), width):
                until = np.searchsorted(doc, np.arange(b - a + 1))
                sums = []
                for salt in (U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)):
                    total = np.concatenate(([U64(0)], np.cumsum(bg.mix(token ^ salt), dtype=U64)))
                    sums.append((total[until[1:]] - total[until[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(until), pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "n", "s1", "s2"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint")


_SENT = "part bigint, chunk bigint, tokens binary, at binary, weight binary, ids binary, sizes binary"
_NAMES = ["part", "chunk", "tokens", "at", "weight", "ids", "sizes"]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)


def _send(width: int, bits: int):
    """Texts to (slice, chunk, tokens, their documents, counts), and per chunk a header under a part below 0."""

    def flush(chunk: int, token: np.ndarray, doc: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        run = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(run, append=len(token))
        often = count >= OFTEN
        each = np.repeat(often, count)
        rows = [(-1 - chunk, chunk, token[each].tobytes(), doc[each].astype(np.uint16).tobytes(), b"", ids.tobytes(), sizes.tobytes())]
        keep = ~each
        keep[run[often]] = True
        weight, at = np.ones(len(token), np.uint32), doc.astype(np.uint16)
        weight[run[often]], at[run[often]] = count[often], _MARK
        token, at, weight = token[keep], at[keep], weight[keep]
        cut = np.searchsorted(token, np.arange(1 << bits, dtype=U64) << U64(64 - bits)) if bits else np.array([0])
        for s, (x, y) in enumerate(zip(cut, [*cut[1:], len(token)], strict=True)):
            if y > x:
                # runs of hashes are sent as differences, without their leading zero bytes
                steps = np.diff(token[x:y], prepend=U64(0))
                lead = steps[1:].max() if y - x > 1 else U64(0)
                size = max(1, (int(lead).bit_length() + 7) // 8)
                packed = steps[:1].tobytes() + bytes([size]) + steps[1:].view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                heavy = weight[x:y] > 1
                rows.append((s, chunk, packed, at[x:y].tobytes(), weight[x:y][heavy].tobytes(), b"", b""))
        for k in range(0, len(rows), 256):
            yield _table(rows[k : k + 256])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        parts: list[tuple[np.ndarray, ...]] = []
        held = n = 0
        for batch in batches:
            all_ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, token, doc in _sets(batch.column("text"), width):
                for lo in range(0, b - a, CHUNK_DOCS):  # very short texts: many documents in few bytes
                    hi = min(b - a, lo + CHUNK_DOCS)
                    x, y = np.searchsorted(doc, [lo, hi])
                    if n and (held + y - x > CHUNK_TOKENS or n + hi - lo > CHUNK_DOCS):
                        yield from flush(chunk, *map(np.concatenate, zip(*parts, strict=True)))
                        chunk, parts, held, n = chunk + 1, [], 0, 0
                    parts.append((token[x:y], doc[x:y] - lo + n, all_ids[a + lo : a + hi], np.bincount(doc[x:y] - lo, minlength=hi - lo).astype(np.int64)))
                    held, n = held + y - x, n + hi - lo
        if held:
            yield from flush(chunk, *map(np.concatenate, zip(*parts, strict=True)))

    return send


def _unpack(packed: bytes) -> np.ndarray:
    first, size = np.frombuffer(packed[:8], U64), packed[8]
    rest = np.frombuffer(packed[9:], np.uint8).reshape(-1, size)
    steps = np.zeros((len(rest), 8), np.uint8)
    steps[:, :size] = rest
    return np.cumsum(np.concatenate((first, steps.view(U64).ravel())), dtype=U64)


def _count(group: pa.Table) -> pa.Table:
    """Frequencies of a slice's tokens. Each chunk gets back those of its tokens that other documents hold too."""
    if group.column("part")[0].as_py() < 0:
        return group
    chunk = group.column("chunk").to_pylist()
    tokens, ats, weights, of = [], [], [], []
    for k, (packed, at, heavy) in enumerate(zip(group.column("tokens").to_pylist(), group.column("at").to_pylist(), group.column("weight").to_pylist(), strict=True)):
        tokens.append(_unpack(packed))
        ats.append(np.frombuffer(at, np.uint16))
        own = np.ones(len(tokens[-1]), np.int64)
        own[ats[-1] == _MARK] = np.frombuffer(heavy, np.uint32)
        weights.append(own)
        of.append(np.full(len(own), k, np.int32))
    token, at, weight, of = np.concatenate(tokens), np.concatenate(ats), np.concatenate(weights), np.concatenate(of)
    order = np.argsort(token, kind="stable")
    token, at, weight, of = token[order], at[order], weight[order], of[order]
    run = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    total = np.add.reduceat(weight, run)
    df = np.repeat(total, np.diff(run, append=len(token)))
    shared = np.flatnonzero(df > 1)
    shared = shared[np.argsort(of[shared], kind="stable")]
    cut = np.searchsorted(of[shared], np.arange(len(chunk) + 1))
    rows = []
    for k, c in enumerate(chunk):
        i = shared[cut[k] : cut[k + 1]]
        if len(i):
            rows.append((0, c, token[i].tobytes(), at[i].tobytes(), np.minimum(df[i], 0xFFFFFFFF).astype(np.uint32).tobytes(), b"", b""))
    return pa.Table.from_batches([_table(rows)])


def _gather(percent: int):
    """A chunk's documents of whose tokens enough are shared: id, size, shared tokens in the common order, their frequencies."""

    def run(group: pa.Table) -> pa.Table:
        tokens, docs, dfs, heavy, head = [], [], [], [], None
        for part, token, at, df, ids, sizes in zip(*(group.column(c).to_pylist() for c in ("part", "tokens", "at", "weight", "ids", "sizes")), strict=True):
            if part < 0:
                head = np.frombuffer(token, U64), np.frombuffer(at, np.uint16), np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
                continue
            token, at, df = np.frombuffer(token, U64), np.frombuffer(at, np.uint16), np.frombuffer(df, np.uint32)
            many = at == _MARK
            heavy.append((token[many], df[many]))
            tokens.append(token[~many])
            docs.append(at[~many].astype(np.int64))
            dfs.append(df[~many].astype(np.int64))
        often, often_at, ids, sizes = head
        if len(often):
            known = np.concatenate([h[0] for h in heavy])
            order = np.argsort(known)
            tokens.append(often)
            docs.append(often_at.astype(np.int64))
            dfs.append(np.concatenate([h[1] for h in heavy])[order][np.searchsorted(known[order], often)].astype(np.int64))
        out = {"doc_id": [], "n": [], "tokens": [], "dfs": []}
        if tokens:
            token, doc, df = np.concatenate(tokens), np.concatenate(docs), np.concatenate(dfs)
            enough = np.bincount(doc, minlength=len(ids)) * 100 >= percent * sizes
            hit = enough[doc]
            token, doc, df = token[hit], doc[hit], df[hit]
            order = np.lexsort((token, df, doc))
            token, doc, df = token[order], doc[order], df[order]
            for d in np.unique(doc):
                x, y = np.searchsorted(doc, [d, d + 1])
                out["doc_id"].append(int(ids[d]))
                out["n"].append(int(sizes[d]))
                out["tokens"].append(token[x:y].tobytes())
                out["dfs"].append(np.minimum(df[x:y], 0xFFFFFFFF).astype(np.uint32).tobytes())
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "dfs": pa.array(out["dfs"], pa.binary())})

    return run


def prefix_keys(n: int, tokens: np.ndarray, dfs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index keys of a set of n tokens, of which `tokens` (in the common order) are shared; the others come before them."""
    alone = n - len(tokens)
    short = n - (percent * n + 99) // 100 + 1
    # sizes of similar sets lie within one step of the levels, so they have a level in common; from 80 % on steps of 1.25 do
    base = min(percent, 80)
    level = 0
    while 100 ** (level + 1) <= n * base ** (level + 1):
        level += 1
    keys = []
    longest = short
    for lv in (level, level + 1):
        size = (100 / base) ** lv
        # similar sets of this level share so many tokens at least, and groups must be fewer
        sure = int(size * (base / 100) ** 2)
        groups = max(1, min(int((1 - percent / 100) * size / PER_GROUP), sure - 1))
        # small sets may share fewer tokens than two, so all tokens are keys on their own
        alone_keys = size < 5 or sure < 2
        end = short if alone_keys else short + groups
        longest = max(longest, end)
        part = tokens[: max(0, end - alone)]
        often = part[dfs[: len(part)] >= FREQUENT]
        salt = U64(lv + 1)
        if alone_keys:
            keys.append(bg.mix(often ^ bg.mix(np.array([salt]))[0]))
            continue
        often = np.sort(often)
        group = bg.mix(often + salt) % U64(groups)
        for g in np.unique(group):
            own = often[group == g]
            if len(own) > 1:
                i, j = np.triu_indices(len(own), 1)
                keys.append(bg.mix(bg.mix(own[i] + salt) ^ (own[j] * U64(0x9FB21C651E98DF25))))
    part = tokens[: max(0, longest - alone)]
    keys.append(bg.mix(part[dfs[: len(part)] < FREQUENT]))
    return np.unique(np.concatenate(keys))


def _keys(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, n, token, df in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens", "dfs")), strict=True):
                keys = prefix_keys(n, np.frombuffer(token, U64), np.frombuffer(df, np.uint32), percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), doc_id)), pa.array(np.full(len(keys), n))], names=["key", "doc_id", "n"])

    return run


def _linked(shared, n1, n2, percent: int):
    return 100 * shared >= percent * (n1 + n2 - shared)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, n, m, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m", "s", "t")), strict=True):
                shared = len(np.intersect1d(np.frombuffer(s, U64), np.frombuffer(t, U64), assume_unique=True))
                if _linked(shared, n, m, percent):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _settle(percent: int):
    """Links between different components among the documents of two blocks."""

    def run(group: pa.Table) -> pa.Table:
        ids, n, own, side = (group.column(c).to_numpy() for c in ("doc_id", "n", "component", "side"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        held = [np.frombuffer(t, U64) for t in group.column("tokens").to_pylist()]
        token = np.concatenate(held)
        doc = np.repeat(np.arange(len(held)), [len(t) for t in held])
        _, which = np.unique(token, return_inverse=True)
        order = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[order], np.arange(which.max() + 2))
        begin = np.searchsorted(doc, np.arange(len(held) + 1))
        links: dict[tuple[int, int], tuple[int, int]] = {}
        for d in np.flatnonzero(side == i):
            w = which[begin[d] : begin[d + 1]]
            size = cut[w + 1] - cut[w]
            at = np.repeat(cut[w], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            shared = np.bincount(doc[order[at]], minlength=len(held))
            for e in np.flatnonzero(_linked(shared, n[d], n, percent) & (own != own[d]) & ((side == j) if i != j else (np.arange(len(held)) > d))):
                links.setdefault((min(own[d], own[e]), max(own[d], own[e])), (int(ids[d]), int(ids[e])))
        pairs = list(links.values())
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _rest(postings: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a key: documents of such keys form clusters, which are compared in pairs of blocks."""
    own = postings.join(known, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = own.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("doc_id").alias("b")).filter("c1 <> c2").select("key", "b")
    open_keys = stage(own.join(split, "key").select(F.col("doc_id").alias("a"), "b", "component"), "open")
    clusters = components(open_keys.select("a", "b"))
    inside = clusters.join(open_keys.select(F.col("a").alias("node"), F.col("component").alias("known")).distinct(), "node")
    blocks = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = inside.join(blocks, "component").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"), F.col("known").alias("component"), "side", other)
    dealt = dealt.select("cluster", "doc_id", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    full = dealt.join(sets.select("doc_id", "n", "tokens"), "doc_id")
    return full.groupBy("cluster", "i", "j").applyInArrow(_settle(percent), "a bigint, b bigint")


def similar_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 * shared >= percent * united distinct shingles. Null text and text without words has no
    shingles and its own id as component. Texts with fewer words than `width` are one shingle. Rows that share an id count
    as one document. Rows without an id link nothing; they take the component of their set's documents, if there are any.
    No rows give no rows. Other columns are not read. Sets are compared as sets of 64-bit hashes.
    """
    bound_batches(docs.sparkSession)
    every = stage(signatures(docs, width), "signatures")
    classes = stage(every.filter("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("class"), F.max("n").alias("n")), "classes")
    # smaller sets are similar to no set but their equal
    least = min(m for m in range(1, 102) if 100 * m >= percent * (m + 1))
    chosen = classes.filter((F.col("n") >= least) & F.col("class").isNotNull()).select(F.col("class").alias("doc_id")).distinct()
    left_out = every.select("doc_id").distinct().join(chosen, "doc_id", "left_anti").filter("doc_id is not null")
    reps = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null").join(small(stage(left_out, "left-out"), 32), "doc_id", "left_anti")
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    bits = max(4, (int(tokens) // SLICE_TOKENS).bit_length())
    sent = reps.mapInArrow(_send(width, bits), _SENT)
    counted = sent.groupBy("part").applyInArrow(_count, _SENT)
    sets = stage(counted.withColumn("part", F.when(F.col("part") < 0, F.col("part")).otherwise(0)).groupBy("chunk").applyInArrow(_gather(percent), "doc_id bigint, n bigint, tokens binary, dfs binary"), "sets")
    postings = stage(sets.mapInArrow(_keys(percent), "key bigint, doc_id bigint, n bigint"), "postings")
    pivots = postings.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    near = (100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (F.col("doc_id") != F.col("p.doc_id"))
    pairs = postings.join(pivots, "key").filter(near).select(F.col("p.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    one = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("t"))
    two = sets.select(F.col("doc_id").alias("a"), "n", F.col("tokens").alias("s"))
    links = stage(pairs.join(one, "b").join(two, "a").select("a", "b", "n", "m", "s", "t").mapInArrow(_verify(percent), "a bigint, b bigint"), "found")
    known = components(links)
    more = stage(_rest(postings, sets, known, percent), "more")
    if not more.isEmpty():
        known = components(links.unionByName(more))
    grouped = classes.join(known, F.col("class") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "class").alias("component_id"))
    full = every.filter("n > 0").join(grouped, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame) -> DataFrame:
    """docs' own columns, of each component the rows with its smallest id.

    Null and empty texts are linked with nothing and stay, as rows without an id do. Rows that share an id stay or go
    together. An empty table stays empty. Columns of any name and with nulls are carried along.
    """
    gone = stage(similar_components(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone, 32), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as shingle from places),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from documents left join sizes using (doc_id) join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id)
"""
