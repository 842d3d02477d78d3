"""Line dedup against a plain version."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest import SCHEMA, rows_of, words
from pyspark.sql import functions as F

from loomline.llm import lines


def plain_chunks(text, window=lines.WINDOW, divisor=lines.DIVISOR):
    own = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in own]
    p = [sum((h[i - k] if i >= k else 0) * lines.BASE**k for k in range(window)) % lines.MODULUS % divisor == 0 for i in range(len(own))]
    starts = [i for i in range(len(own)) if i == 0 or (i > 1 and p[i - 1] and not p[i - 2])]
    return own, [(a, own[a:b]) for a, b in zip(starts, [*starts[1:], len(own)], strict=True) if sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in own[a:b]) > 1]


def plain(texts, **options):
    seen, gone = set(), defaultdict(list)
    for k, (_, text) in sorted(enumerate(texts), key=lambda r: (r[1][0] is None, r[1][0] or 0)):
        for pos, chunk in plain_chunks(text, **options)[1]:
            if tuple(chunk) in seen:
                gone[k].append((pos, len(chunk)))
            seen.add(tuple(chunk))
    out = []
    for k, (i, text) in enumerate(texts):
        own = (text or "").split("\n")
        drop = {x for pos, n in gone[k] for x in range(pos, pos + n)}
        out.append((i, len(own), len(gone[k]), len(drop), "\n".join(x for j, x in enumerate(own) if j not in drop)))
    return out


@pytest.fixture(scope="module")
def lined(texts):
    """The common odd cases, and texts of lines: shared passages moved about, blank lines, hot and repeated lines."""
    rng = random.Random(8)
    line = lambda: words(rng, rng.randint(1, 9))
    passage, hot = [line() for _ in range(14)], [line() for _ in range(6)]
    out = list(texts)
    out += [(100 + k, "\n".join([line() for _ in range(k % 5)] + passage + [line() for _ in range(k % 3)])) for k in range(12)]
    out += [(200 + k, "\n".join([*hot, line()])) for k in range(300)]
    out += [(600, "\n".join(passage * 3)), (601, "\n" * 40), (602, "same\n" * 50), (603, "a\n\n\na\n\n\na"), (604, "x\r\ny\r\n" * 9), (605, "\n".join(hot)), (None, "\n".join(hot)), (None, "\n".join(hot))]
    out += [(606, "\n".join(line() for _ in range(20_000))), (600, "\n".join(passage * 3))]
    return out


@pytest.mark.parametrize("options", [{}, {"window": 3, "divisor": 3}])
def test_repeated_chunks_of_lines_go(spark, lined, options):
    docs = spark.createDataFrame(rows_of(lined), SCHEMA).repartition(3)
    wanted = plain(lined, **options)
    assert sum(r[2] for r in wanted) > 100
    left = lines.without_repeated_lines(docs, **options)
    assert left.columns == [*docs.columns, "n_lines", "n_removed_chunks", "n_removed_lines"]
    found = [tuple(r) for r in left.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", "text").collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_bytes_decide_where_digests_agree(spark, lined, monkeypatch):
    weak = lambda chunk: F.unhex(F.substring(F.md5(chunk.cast("binary")), 1, 2))
    docs = spark.createDataFrame(rows_of(lined), SCHEMA).repartition(3)
    found = [tuple(r) for r in lines.without_repeated_lines(docs, digest=weak).select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", "text").collect()]
    assert sorted(found, key=str) == sorted(plain(lined), key=str)


def test_shift_resistance_and_empty_tables(spark, none):
    rng = random.Random(4)
    body = [words(rng, 5) for _ in range(40)]
    texts = [(1, "\n".join(body)), (2, "\n".join(["new first line", *body[:20], "put in", *body[20:]]))]
    lost = {r["doc_id"]: r["n_removed_lines"] for r in lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert lost[1] == 0 and lost[2] >= 24
    assert lines.repeated_lines(none).count() == 0 and lines.without_repeated_lines(none).count() == 0
    again = spark.createDataFrame([(1, "a\nb", 5)], "doc_id long, text string, n_lines int")
    assert lines.without_repeated_lines(again).columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed_chunks", "n_removed_lines"]
