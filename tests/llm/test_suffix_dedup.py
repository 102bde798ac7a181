"""Repeated byte strings against a table of all windows."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import suffix_dedup as D
from ridgeline.llm.common import shared_folder


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                hit[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, hit].astype(int))).tolist()
        spans = list(zip(edges[::2], edges[1::2], strict=True))
        out.append((len(b), int(hit.sum()), spans, bytes(c for c, h in zip(b, hit, strict=False) if not h)))
    return out


def texts(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda n, a="abcdefghij ": "".join(rng.choice(list(a), n))
    base, passage = word(3000), word(260)
    out = [None, "", "short", base, base, base[:1500] + "X" + base[1501:], base[700:], passage, word(500) + passage + word(300)]
    out += [word(30) + passage + word(40) for _ in range(40)] + [word(9) + passage[5:215] + word(250) for _ in range(20)]
    out += ["ab" * 400, "a" * 700, "b" + "a" * 150, "a" * 199, "a" * 200, "é" * 300, "中文" * 100 + word(50), "文" + "中文" * 90]
    out += [word(900, "ab") for _ in range(12)] + [word(400) * 2, word(199) + word(1) * 2]
    for _ in range(30):
        i = int(rng.integers(0, 2400))
        t = list(base[i:i + 600])
        for j in rng.integers(0, 600, 3):
            t[int(j)] = "#"
        out.append("".join(t))
    return out


def removed(spark, rows, length):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(rows)], "doc_id bigint, text string, text_key string, size int, spans_ int").repartition(5)
    got = sorted(D.removal(df, "text", shared_folder(spark), length).collect(), key=lambda r: r.doc_id)
    assert all(r.text_key == "x" and r.size == 1 for r in got)
    return [(r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got]


def test_removed_bytes(spark):
    rows = texts()
    assert removed(spark, rows, 200) == brute(rows, 200)


@pytest.mark.parametrize("length,crowd", [(16, 3), (7, 1 << 16), (50, 5)])
def test_crowded_anchors_and_small_blocks(spark, monkeypatch, length, crowd):
    monkeypatch.setattr(D, "CROWD", crowd)
    monkeypatch.setattr(D, "BUCKET_ROWS", 64)
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    rows = [t[:400] if t else t for t in texts(length)][:60]
    assert removed(spark, rows, length) == brute(rows, length)


def test_nothing(spark):
    assert removed(spark, [], 200) == []
    assert removed(spark, [None, "", "abc"], 200) == brute([None, "", "abc"], 200)


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 100)
    text = texts()[3].encode()
    starts = [s for part in D.units(text, 200) for p, n in zip(part[2], part[4], strict=True) for s in range(p, p + n)]
    assert starts == list(range(len(text) - 199))


def test_merge_of_shards_is_the_transform_of_all():
    """Interleaving three shards gives the neighbours that sorting all suffixes gives."""
    rng = np.random.default_rng(3)
    rows = rng.choice(np.frombuffer(b"ab", np.uint8), (90, 40)).astype(np.uint8)
    rows[50:] = rows[:40]
    rows[50:, 12] = ord("c")
    cols = np.ascontiguousarray(rows.T)
    one = np.zeros(30, np.uint16)
    shards = [D.transform(np.ascontiguousarray(cols[:, i:i + 30]), one) for i in (0, 30, 60)]
    first, last = D.merge(shards, 10, np.zeros(90, int), np.full(90, 31))
    for r in range(90):
        hits = [c for c in range(31) if any(q != r and (rows[q, c:c + 10] == rows[r, c:c + 10]).all() for q in range(90))]
        assert (first[r], last[r]) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_query(spark, sf):
    got = {r.doc_id: r for r in D.op13_suffix_dedup(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for r, (n, gone, spans, kept) in zip(rows, brute([r.text for r in rows], 200), strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, gone, len(spans), hashlib.sha256(kept).hexdigest())
