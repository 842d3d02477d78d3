"""Removal of long byte strings that occur more than once in a corpus.

A byte goes when a string of `length` bytes over it also starts anywhere else. Each window of that length picks one anchor,
its run of GRAM bytes with the smallest hash (the leftmost), which depends on the window's bytes alone: equal windows have
equal anchors. Only anchors that occur twice matter. The text around those is sent to hash slices, once for equal
surroundings in a task. There an induced suffix sort with common prefixes (suffixes.py) finds the windows whose bytes occur
again; windows of very frequent anchors are dealt out by a salt, and counted by BLAKE2 digests over the salts afterwards. Equal texts are told by SHA-256
first and compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesgrams as bg
from . import suffixes
from .common import ARROW_BYTES, WORD, bound_batches, placed, small, spread_join, stage

LENGTH, GRAM = 400, 128
#: Occurrences of an anchor that one salt takes, and surroundings in a slice, about.
PER_SALT, PER_SLICE = 1024, 4_000

U64 = np.uint64
_BASE = bg.BASE
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return bg.powers(1 << bits), bg.powers(1 << bits, _INVERSE)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes' values times powers, and the inverse powers: any run's hash is a difference times a power."""
    up, down = _powers(max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(bg.BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return total, down


def _hashes(total: np.ndarray, down: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    if isinstance(at, slice):
        return bg.mix((total[size:] - total[:-size]) * down[: len(total) - size])
    return bg.mix((total[at + size] - total[at]) * down[at])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its first window, how many windows, text) in order. The windows of an anchor follow each other."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    total, down = _sums(data)
    value = _hashes(total, down, slice(None), gram)
    value = (value >> U64(32) << U64(32)) | np.arange(len(value), dtype=U64)
    width = length - gram + 1
    pad = -len(value) % width
    blocks = np.concatenate((value, np.full(pad, np.iinfo(U64).max, U64))).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    fits = np.zeros(n + 1, np.int32)
    long = sizes >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(fits[:n]) > 0)
    if not len(window):
        return none, none, none, none
    least = least[window]
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (window[1:] != window[:-1] + 1))))
    return least[first], window[first], np.diff(first, append=len(window)), np.searchsorted(offsets, window[first], "right") - 1


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in bg.chunks(batch.column("text"), ARROW_BYTES):
            at, _, _, doc = anchors(data, offsets)
            if len(at):
                total, down = _sums(data)
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_hashes(total, down, at, GRAM).view(np.int64)), batch.column("_file").take(take), batch.column("_row").take(take), pa.array((at - offsets[doc]).astype(np.int32))],
                    names=["anchor", "_file", "_row", "at"],
                )


#: A passage is long from so many words on. It is found by runs of FEWER words, of which every PASSAGE words hold a chosen one.
PASSAGE, FEWER = 51, 45
#: Chosen runs in a slice, about.
RUNS_PER_SLICE = 500_000


def chosen_runs(data: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE, fewer: int = FEWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of runs of `fewer` words, each once a text: of the runs inside every `passage` words the one with the smallest hash, the first of such."""
    w = bg.words(data, offsets, lower=False)
    n = len(w.hash) - fewer + 1
    if n <= passage - fewer:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(len(w.hash) + 1, U64)
    np.cumsum(w.hash * bg.powers(len(w.hash)), out=total[1:])
    run = bg.mix((total[fewer:] - total[:-fewer]) * bg.powers(n, _INVERSE))
    within = np.lib.stride_tricks.sliding_window_view(run, passage - fewer + 1)
    at = np.flatnonzero(w.doc[: n - passage + fewer] == w.doc[passage - 1 :])
    pick = at + np.argmin(within[at], axis=1)
    pick = np.unique(pick)
    order = np.lexsort((run[pick], w.doc[pick]))
    pick = pick[order]
    first = np.ones(len(pick), bool)
    first[1:] = (run[pick][1:] != run[pick][:-1]) | (w.doc[pick][1:] != w.doc[pick][:-1])
    return run[pick[first]], w.doc[pick[first]]


_RUNS = "slice bigint, hashes binary, texts binary, files binary, rows binary"


def _send_runs(slices: int):
    """The chosen runs of the texts of a chunk by slice of their hash: hashes, and for each the text that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = batch.column("_file").to_numpy(), batch.column("_row").to_numpy()
            for a, b, data, offsets in bg.chunks(batch.column("text"), ARROW_BYTES):
                hashes, doc = chosen_runs(data, offsets)
                own = (hashes >> U64(32)) % U64(slices)
                order = np.argsort(own, kind="stable")
                cut = np.searchsorted(own[order], np.arange(slices + 1))
                out = []
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    i = order[cut[k] : cut[k + 1]]
                    texts, at = np.unique(doc[i], return_inverse=True)
                    out.append((k, hashes[i].tobytes(), at.astype(np.int32).tobytes(), files[a + texts].tobytes(), rows[a + texts].tobytes()))
                for k in range(0, len(out), 256):
                    part = list(zip(*out[k : k + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *(pa.array(x, pa.binary()) for x in part[1:])], names=["slice", "hashes", "texts", "files", "rows"])

    return run


def _shared_runs(group: pa.Table) -> pa.Table:
    """The texts of a slice that hold a run that another text holds too, each once."""
    hashes, texts, files, rows, n = [], [], [], [], 0
    for h, t, f, r in zip(*(group.column(c).to_pylist() for c in ("hashes", "texts", "files", "rows")), strict=True):
        hashes.append(np.frombuffer(h, U64))
        texts.append(np.frombuffer(t, np.int32) + n)
        files.append(np.frombuffer(f, np.int64))
        rows.append(np.frombuffer(r, np.int64))
        n += len(files[-1])
    hashes, texts, files, rows = map(np.concatenate, (hashes, texts, files, rows))
    # a run is in a text once, and a text in one chunk only
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    found = np.unique(texts[count[which] > 1])
    return pa.table({"_file": pa.array(files[found]), "_row": pa.array(rows[found])})


_PLACE = np.dtype([("file", "<i8"), ("row", "<i8"), ("start", "<i8")])
_SENT = "slice bigint, salts int, windows int, around binary, places binary"


def _surroundings(slices: int):
    """The text that each repeated anchor's windows cover, once for equal text in a chunk, with all places where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, rows = batch.column("_file").to_numpy(), batch.column("_row").to_numpy()
            wanted, salts_of = batch.column("at"), batch.column("salts")
            for a, b, data, offsets in bg.chunks(batch.column("text"), ARROW_BYTES):
                at, window, count, doc = anchors(data, offsets)
                own = [np.asarray(wanted[a + d].values) + offsets[d] for d in range(b - a)]
                salted = np.concatenate([np.asarray(salts_of[a + d].values) for d in range(b - a)])
                own = np.concatenate(own)
                order = np.argsort(own)
                own, salted = own[order], salted[order]
                spot = np.minimum(np.searchsorted(own, at), len(own) - 1)
                hit = own[spot] == at
                at, window, count, doc, salts = at[hit], window[hit], count[hit], doc[hit], salted[spot[hit]]
                total, down = _sums(data)
                anchor = _hashes(total, down, at, GRAM)
                end = window + count - 1 + LENGTH
                raw = data.tobytes()
                held: dict[bytes, list[int]] = {}
                for k, (x, y) in enumerate(zip(window.tolist(), end.tolist(), strict=True)):
                    held.setdefault(raw[x:y], []).append(k)
                place = np.empty(len(at), _PLACE)
                place["file"], place["row"], place["start"] = files[a + doc], rows[a + doc], window - offsets[doc]
                first = np.array([own[0] for own in held.values()], np.int64)
                spread = bg.mix(anchor[first] ^ bg.mix(files[a + doc[first]].view(U64) + rows[a + doc[first]].view(U64))) % np.maximum(salts[first], 1).astype(U64)
                out = {
                    "slice": (bg.mix(anchor[first] + spread) % U64(slices)).astype(np.int64), "salts": salts[first].astype(np.int32), "windows": count[first].astype(np.int32),
                    "around": list(held), "places": [place[own].tobytes() for own in held.values()],
                }
                yield pa.RecordBatch.from_arrays([pa.array(out["slice"], pa.int64()), pa.array(out["salts"], pa.int32()), pa.array(out["windows"], pa.int32()), pa.array(out["around"], pa.binary()), pa.array(out["places"], pa.binary())], names=list(out))

    return run


_FOUND = "window binary, _file bigint, _row bigint, start bigint, size int"


def _compare(group: pa.Table) -> pa.Table:
    """Runs of repeated windows (window null), and windows of salted anchors that no other here equals, or one place-less row for those that do."""
    held: dict[bytes, tuple[int, int, list[bytes]]] = {}
    for around, n, parts, own in zip(*(group.column(c).to_pylist() for c in ("around", "windows", "salts", "places")), strict=True):
        held.setdefault(around, (n, parts, []))[2].append(own)
    data = np.frombuffer(b"".join(held), np.uint8)
    offsets = np.cumsum([0, *map(len, held)])
    windows, salts = (np.array([x[k] for x in held.values()], np.int64) for k in (0, 1))
    places = [np.frombuffer(b"".join(x[2]), _PLACE) for x in held.values()]
    copies = np.array([len(p) for p in places])
    of = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[of] + within
    which = suffixes.classes(data, at, LENGTH)
    n = np.bincount(which, weights=copies[of])[which]
    twice = n > 1
    begin = np.flatnonzero(twice & np.concatenate(([True], ~twice[:-1] | (of[1:] != of[:-1]))))
    stop = np.flatnonzero(twice & np.concatenate((~twice[1:] | (of[1:] != of[:-1]), [True])))
    order = np.argsort(of[begin], kind="stable")
    begin, stop = begin[order], stop[order]
    cut = np.searchsorted(of[begin], np.arange(len(places) + 1))
    files, rows, starts, sizes = [], [], [], []
    for r in np.unique(of[begin]) if len(begin) else []:
        x, y = cut[r], cut[r + 1]
        p = places[r]
        files.append(np.repeat(p["file"], y - x))
        rows.append(np.repeat(p["row"], y - x))
        starts.append((p["start"][:, None] + within[begin[x:y]]).ravel())
        sizes.append(np.tile(within[stop[x:y]] - within[begin[x:y]] + 1, len(p)))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    runs = pa.table({"window": pa.nulls(len(join(files)), pa.binary()), "_file": pa.array(join(files)), "_row": pa.array(join(rows)), "start": pa.array(join(starts)), "size": pa.array(join(sizes).astype(np.int32))})
    spread = salts[of] > 1
    single = np.flatnonzero(spread & ~twice)
    one = [places[r][0] for r in of[single]]
    _, seen = np.unique(np.where(spread & twice, which, -1), return_index=True)
    seen = seen[(spread & twice)[seen]]
    raw = data.tobytes()
    alone = pa.table({
        "window": pa.array([hashlib.blake2b(raw[x : x + LENGTH], digest_size=16).digest() for x in at[np.concatenate((single, seen))].tolist()], pa.binary(16)).cast(pa.binary()),
        "_file": pa.array([int(p["file"]) for p in one] + [None] * len(seen), pa.int64()),
        "_row": pa.array([int(p["row"]) for p in one] + [None] * len(seen), pa.int64()),
        "start": pa.array([int(p["start"] + w) for p, w in zip(one, within[single], strict=True)] + [None] * len(seen), pa.int64()),
        "size": pa.array([1] * (len(one) + len(seen)), pa.int32()),
    })
    return pa.concat_tables([runs, alone])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes removed, runs removed, and the digest of what is left."""
    for batch in batches:
        removed, spans, digests = [], [], []
        for text, starts, sizes in zip(batch.column("text"), batch.column("starts"), batch.column("sizes"), strict=True):
            raw = text.as_buffer().to_pybytes()
            change = np.zeros(len(raw) + 1, np.int32)
            start = np.asarray(starts.values, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + np.asarray(sizes.values, np.int64) - 1 + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            digests.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_file", "_row")), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["_file", "_row", "removed", "spans", "left"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage.

    Null text counts as empty; texts shorter than the window lose nothing; texts that are equal as a whole, if long enough,
    lose all. Ids may be null or repeated: rows are told apart by where they lie. No rows give no rows. Other columns are
    not read.

    A passage of 51 words can have fewer than 400 bytes, and then stays. shares_passage says whether the text holds a run of
    words that another text holds too: every shared run of PASSAGE words or more is found, one of FEWER words or more may be,
    a shorter one never is. Words are compared by 64-bit hashes, without the white space between them.
    """
    bound_batches(docs.sparkSession)
    docs = docs if placed(docs) else stage(docs.select("doc_id", "text"), "rows")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    known = stage(rows.select("doc_id", "_file", "_row", F.octet_length("text").cast("bigint").alias("n_bytes"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("n_words"), F.unhex(sha).alias("digest")), "digests")
    equal = known.groupBy("digest").agg(F.min(F.struct("_file", "_row")).alias("rep"), F.count(F.lit(1)).alias("copies"))
    is_rep = (F.col("rep._file") == F.col("_file")) & (F.col("rep._row") == F.col("_row"))
    # texts with copies are told by their digest wherever their rows lie; the others stand for themselves
    twice = stage(equal.filter("copies > 1"), "twice")
    known = stage(spread_join(known, twice, ["digest"], "copies", "left").select("doc_id", "_file", "_row", "n_bytes", "n_words", "digest", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce(is_rep, F.lit(True)).alias("is_rep")), "known")
    again = known.filter("not is_rep").select("_file", "_row")
    work = rows.select("_file", "_row", "text").filter(F.octet_length("text") >= LENGTH).join(small(again, 32), ["_file", "_row"], "left_anti")
    found = stage(work.mapInArrow(_find, "anchor bigint, _file bigint, _row bigint, at int"), "anchors")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    # anchors that need more than one salt are few at any size: a PER_SALT-th of all anchors at most
    hot = small(stage(twice.filter("salts > 1"), "hot"), 32)
    known_twice = found.join(hot, "anchor").unionByName(found.join(hot, "anchor", "left_anti").join(twice.filter("salts = 1"), "anchor"))
    wanted = stage(known_twice.groupBy("_file", "_row").agg(F.collect_list("at").alias("at"), F.collect_list("salts").alias("salts")), "wanted")
    sent = wanted.agg(F.sum(F.size("at"))).first()[0] or 0
    slices = max(16, -(-sent // PER_SLICE))
    # only texts with such anchors go on; they are shuffled once as part of all texts, and then among themselves
    involved = stage(work.join(wanted, ["_file", "_row"]), "involved")
    around = involved.mapInArrow(_surroundings(slices), _SENT)
    compared = stage(around.groupBy("slice").applyInArrow(_compare, _FOUND), "compared")
    spread = compared.filter("window is not null")
    more = spread.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    windows = compared.filter("window is null").unionByName(spread.filter("_file is not null").join(more, "window").select(*compared.columns))
    runs = windows.groupBy("_file", "_row").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    texts = involved.select("_file", "_row", "text")
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    worded = rows.select("_file", "_row", "text").filter(F.octet_length("text") >= 2 * PASSAGE - 1).join(small(again, 32), ["_file", "_row"], "left_anti")
    shared = stage(worded.mapInArrow(_send_runs(max(4, total // (RUNS_PER_SLICE * 24))), _RUNS).groupBy("slice").applyInArrow(_shared_runs, "_file bigint, _row bigint").distinct(), "shared")
    shared = shared.withColumn("shared", F.lit(True))
    cut = stage(texts.join(runs, ["_file", "_row"]).mapInArrow(_cut, "_file bigint, _row bigint, removed bigint, spans bigint, left string"), "cut")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    # a copy of a text shares its passages with it
    copied = (F.col("copies") > 1) & (F.col("n_words") >= PASSAGE)
    return known.join(small(cut, 128), ["_file", "_row"], "left").join(small(shared, 32), ["_file", "_row"], "left").select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("left", F.lower(F.hex("digest")))).alias("kept_sha256"),
        (copied | F.coalesce("shared", F.lit(False))).alias("shares_passage"),
    )
