"""Repeated ids and rows, clashing names, hot keys and draws at the cap."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import language as L
from ridgeline.llm import mixing as M
from ridgeline.llm import ngram_join as J
from ridgeline.llm import quality as Q
from ridgeline.llm import sharding as S
from ridgeline.llm import token_counts as T


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def test_shards_keep_every_column(spark, monkeypatch):
    monkeypatch.setattr(S, "SPAN_ROWS", 8)
    rows = [(i * 10**12, f"t{i}", i, "a", 2.0, "b", 9, "z") for i in range(150)]
    rows += [(None, f"null {i}", i, "a", 2.0, "b", 9, "z") for i in range(120)] + [(7, "same", 1, "a", 2.0, "b", 9, "z")] * 40 + [(7, f"seven {i}", 1, "a", 2.0, "b", 9, "z") for i in range(60)]
    names = ["id", "body", "_key", "_span", "_rank", "_jump", "slot", "row"]
    d = spark.createDataFrame(rows, "id bigint, body string, _key int, _span string, _rank double, _jump string, slot int, row string").repartition(5)
    got = S.assign_shards(d, "id", "body", 6)
    assert got.columns == [n for n in names if n != "slot"] + ["size", "text_crc32", "shard", "slot", "grown_shard"]
    got = got.collect()
    assert Counter((r.id, r.body, r._key, r._span, r._rank, r._jump, r.row) for r in got) == Counter((*r[:6], r[7]) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(((-1 if r.id is None else r.id, r.text_crc32, r["size"]), r.slot))
    for own in by.values():
        own.sort(key=lambda x: x[1])
        assert [s for _, s in own] == list(range(len(own))) and [k for k, _ in own] == sorted(k for k, _ in own)


def test_spans_sort_as_keys_do(spark):
    edges = [3, 9, 10, 20, 33]
    d = spark.range(60).select("id", (F.col("id") * 7919 % 4000 * 10**6).alias("crc")).select("id", "crc", S.key_span(F.col("id"), F.col("crc"), edges, {9, 20}).alias("s"))
    got = sorted(map(tuple, d.collect()))
    assert [g[2] for g in got if g[0] not in (9, 20)] == sorted(g[2] for g in got if g[0] not in (9, 20))
    nine = next(g[2] for g in got if g[0] == 9)
    assert next(g[2] for g in got if g[0] == 8) < nine - nine % 4096 and nine % 4096 == (9 * 7919 % 4000 * 10**6) >> 20
    assert next(g[2] for g in got if g[0] == 10) > nine


def test_an_id_on_two_texts(spark):
    a, b = text(1), text(2)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, text(3)), (4, text(3)), (5, text(4)), (5, text(5)), (6, text(5)), (7, None), (7, text(6))]
    d = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    got = sorted((r.id, r.component_id, r.n_links) for r in J.jaccard_join(d, 4, 85).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (4, 4, 0), (5, 5, 0), (5, 5, 0), (6, 5, 0), (7, 7, 0), (7, 7, 0)]


def test_equal_rows_are_encoded_once(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "one two")] * 1000 + [(2, "three")] * 70, "doc_id bigint, text string").repartition(7)
    d = d.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text").repartition(3, "digest")
    assert T.encode_texts(d, "v", open(path, encoding="utf-8").read()).count() == 2


def test_letters():
    assert not L.has_letter("½ ² Ⅷ 12 _ !") and L.has_letter("½ é") and not L.has_letter("")


def test_language_of_a_whole_text(spark):
    """Windows, weights and choice against a loop over each window's bytes."""
    net = L.train(["the and with " * 40, "la que ción " * 40] * 4, ["en", "es"] * 4)
    texts = ["the and " * 300, "la que " * 5 + "the " * 200, "x", "é" * 700, "the and with " * 10 + "la que " * 9]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in L.identify(d, net).collect()}
    for i, t in enumerate(texts):
        raw, total, weight = t.lower().encode(), np.zeros(2), 0
        for at in range(0, max(1, len(raw) - (L.WINDOW - L.STRIDE)), L.STRIDE):
            part = raw[at:at + L.WINDOW]
            window = np.frombuffer(part.ljust(L.WINDOW, b" "), np.uint8)[None]
            e = net.embedding[window]
            best = [np.max([(e[0, k:k + len(f)] * f.transpose(2, 0, 1)).sum(axis=(1, 2)) for k in range(L.WINDOW - len(f) + 1)], axis=0) for f in net.filters]
            h = np.maximum(np.concatenate(best) + net.bias, 0) @ net.dense + net.dense_bias
            p = np.exp(h - h.max())
            total, weight = total + p / p.sum() * len(part), weight + len(part)
        assert got[i].lang_pred == net.languages[int(total.argmax())] and got[i].score == pytest.approx(total.max() / weight, abs=1e-4)


def test_quality_updates_one_weight_at_a_time():
    """Features and updates against dictionaries and a loop over coordinates."""
    texts = ["Good plain words here, plain words.", "BUY NOW NOW NOW!!! cheap", None, "", "good words", "buy cheap cheap"]
    labels = [1, 0, 0, 1, 1, 0]

    def plain(t):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", (t or "").encode())
        h = [Q.CAPITALS if len(w) > 1 and w.isupper() else xxhash.xxh3_64_intdigest(w.lower()) for w in tokens]
        pairs = [int(Q.REPEATED) if a == b else ((a * int(Q.PAIR)) & (2**64 - 1)) ^ (b >> 7) for a, b in zip(h, h[1:], strict=False)]
        n = Counter(x >> (64 - Q.BITS) for x in h + pairs)
        size = math.sqrt(sum(v * v for v in n.values()))
        return {k: v / size for k, v in n.items()}

    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        least, ridge = (0.0, 0.0) if k == "bias" else (Q.L1, Q.L2)
        return 0.0 if abs(z[k]) <= least else -(z[k] - math.copysign(least, z[k])) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + ridge)

    order = np.random.default_rng(5)
    for _ in range(Q.EPOCHS):
        for i in order.permutation(len(texts)):
            x = plain(texts[i]) | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / Q.ALPHA * w[k]
                n[k] += g * g
    model = Q.train(texts, labels)
    for t in [*texts, "good cheap NOW"]:
        want = 1 / (1 + math.exp(-weight("bias") - sum(weight(k) * v for k, v in plain(t).items())))
        assert model.score(t) == pytest.approx(want, abs=1e-5)


def test_repeated_ids_learn_from_the_smallest_text(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a"), (2, None), (2, "z"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    got, want = Q.learn(docs, labels, F.lit(True)), Q.train(["a a", "z", None], [0, 1, 1])
    assert got.bias == want.bias and (got.weights == want.weights).all()


def test_sources_at_their_cap_get_their_slots(spark):
    """Small sources at the cap beside a large one: what draws take too often is drawn again."""
    rows = [(s * 1000 + i, "w " * 16, f"s{s}") for s in range(10) for i in range(40)] + [(10**6 + i, "w " * 640, "z") for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = {f"s{s}": 640 for s in range(10)} | {"z": 1_280_000}
    for seed in (1, 2):
        taken, target = Counter(), {}
        got = M.mix(d, slots=8, seed=seed).collect()
        for r in got:
            assert r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(target[s] == 3 * n for s, n in sizes.items() if s != "z")
        assert all(abs(taken[s] - target[s]) <= 2 * M.BLOCK_TOKENS for s in sizes)
        assert abs(sum(taken.values()) - sum(sizes.values())) <= 64


def test_crc_is_the_standard_one():
    assert zlib.crc32(b"123456789") == 0xCBF43926
