"""Every operator against brute force, over rows that are awkward in every way."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import components as C
from ridgeline.llm import decontamination as D
from ridgeline.llm import language as L
from ridgeline.llm import licenses as LI
from ridgeline.llm import mixing as M
from ridgeline.llm import ngram_join as J
from ridgeline.llm import quality as Q
from ridgeline.llm import sharding as S
from ridgeline.llm import token_counts as T
from ridgeline.llm import topk as K
from ridgeline.llm import warc as W

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, score string, key string, found int"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


ITEM = words(1, 14)
TEXTS = [
    None, "", " \n\t ", "one", "one two", words(2, 60), words(2, 60), words(2, 60) + " x", "Q " + words(2, 60), words(3, 9000), words(3, 9000) + " tail",
    words(4, 30) + "\n" + ITEM.upper().replace(" ", ", ") + " " + words(5, 7), ITEM[:40], "the the the the the the the the the the the the", "é à ü ß 中文 字",
    "All rights reserved.\nhello", "Copyright 2020 X\n(c) Y\nLICENSED under the mit LICENCE!!", "a  b   c \n d <|endoftext|> e", "!!! ???"]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(TEXTS)]
    out += [(None, TEXTS[5], None, None), (5, TEXTS[5], "en", "s2"), (5, TEXTS[5], "en", "s2"), (-7, "minus one two three four", "fr", "s0"), (1 << 40, words(6, 5), "fr", "Z")]
    return [(*r, 1, 2, "x", "y", "z", 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pick(df, **cols):
    return df.select(*[F.col(c).alias(k) for k, c in cols.items()])


def jump(key, n):
    key, b, j = key & ((1 << 64) - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, rows, empty):
    got = S.assign_shards(docs, "doc_id", "text", 7).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        k, raw = -1 if r.doc_id is None else r.doc_id, (r.text or "").encode()
        assert (r["shard"], r.grown_shard) == (jump(k, 7), jump(k, 8)) and r.grown_shard in (r["shard"], 7)
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.key == "z"
        slots[r["shard"]].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert S.assign_shards(empty, "doc_id", "text", 7).count() == 0


def targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    out, free, left = {}, set(order), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(docs, rows, empty, spark):
    use = lambda d: pick(d, doc_id="doc_id", text="text", source="source")
    got = M.mix(use(docs), block=4, slots=32).collect()
    again = M.mix(use(docs.repartition(5)), block=4, slots=32).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, again))
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] + 12 for s in want)
    assert M.mix(use(empty)).count() == 0
    assert [r.taken for r in M.mix(use(docs.where("doc_id between 0 and 2"))).collect()] == [0, 0, 0]
    for n in (1, 2, 3, 17, 64):
        d = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3).cast("bigint")).alias("p"))
        assert sorted(r.p for r in d.collect()) == list(range(n))


def test_mixing_small_sources(spark):
    sizes = {f"s{n:03}": n for n in range(5, 201, 3)} | {"z": 6400}
    d = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id bigint, text string, source string")
    got = {r.source: r for r in M.mix(d).collect()}
    assert all(got[s].taken <= 3 * n for s, n in sizes.items())
    for low, high in ((5, 30), (30, 64), (64, 128), (128, 201)):
        some = [got[s] for s, n in sizes.items() if low <= n < high]
        assert sum(r.taken for r in some) == pytest.approx(sum(r.target for r in some), rel=0.1)
    alone = M.mix(d.where("source = 's011'")).collect()
    assert [(r.taken, r.target) for r in alone] == [(11, 11.0)]


def test_token_counts(docs, rows, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    use = lambda d: T.count_tokens(pick(d, doc_id="doc_id", text="text"), path, f"file://{tmp_path}/cache")
    want = sorted(map(repr, ((r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)))
    for _ in range(2):
        assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in use(docs).collect()))) == want
    cache = docs.sparkSession.read.parquet(f"file://{tmp_path}/cache")
    assert cache.count() == len({r[1] or "" for r in rows})
    assert use(empty).count() == 0


def test_token_chunks_agree_with_the_library():
    import random
    from pathlib import Path

    import public_tokenizers

    e, rng = T.Encoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()), random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "<|endoftext|>", "'s", "12", "!!", "\x85", "　", "\x1c", "​", "\r"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert e.count(x) == e.whole(x)


def test_language(docs, rows, empty):
    net = L.train(["the and with " * 9, "la que ción " * 9] * 4, ["en", "es"] * 4)
    assert L.train([], []) is None and L.train(["12", None], ["en", "en"]) is None
    for d, n in ((docs, net), (docs, None), (empty, net)):
        got = L.identify(pick(d, doc_id="doc_id", text="text"), n).collect()
        assert len(got) == (0 if d is empty else len(rows))
        assert all(r.lang_pred in ("en", "es", "und") and 0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r for r in L.identify(pick(docs, doc_id="doc_id", text="text"), net).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {0, 1, 2, 18} and got[13].lang_pred == "en"


def test_language_tables_are_the_network():
    rng = np.random.default_rng(0)
    net, x = L.ByteNetwork.fresh(["a", "b"], rng), rng.integers(0, 256, (5, L.WINDOW)).astype(np.uint8)
    e, pooled = net.embedding[x], []
    for f in net.filters:
        v = sum(e[:, i:L.WINDOW - len(f) + 1 + i] @ f[i] for i in range(len(f)))
        pooled.append(v.max(axis=1))
    h = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
    np.testing.assert_allclose(net.probabilities(x, net.tables()), L.softmax(h @ net.dense + net.dense_bias), rtol=1e-4, atol=1e-6)


def held_out(spark, sf, name, modulus, rest):
    from ridgeline.llm.queries import QUERIES

    got = QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
    return [r for r in got if r.held_out]


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = held_out(spark, sf, "op3_language_id", 4, 2)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in held_out(spark, sf, "op9_quality_classifier", 5, 0) if r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in rows]) > 0.95


def test_quality_rows(docs, rows, empty):
    model = Q.train([r[1] for r in rows], [1] * len(rows))
    got = Q.score_rows(pick(docs, doc_id="doc_id", text="text"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.score_rows(pick(docs, text="text"), Q.train([], [])).collect()} == {0.5}
    assert Q.score_rows(pick(empty, text="text"), model).count() == 0


def brute_windows(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(D.UPPER, D.LOWER))) if w]


def brute_contamination(text, items):
    w, hit, found = brute_windows(text), set(), set()
    for i, t in items:
        item = brute_windows(t)
        n = min(10, len(item))
        wins = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k:k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination(docs, rows, spark, empty):
    items = [(3, ITEM), (3, ITEM), (12, "the"), (2, "the the"), (4, None), (None, "minus one two three four"), (8, words(3, 400)), (9, "absent words"), (10, "")]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id bigint, text string, found string")
    got = D.decontaminate(pick(docs, doc_id="doc_id", text="text", keep="key"), table).collect()
    want = sorted(map(repr, ((r[0], *brute_contamination(r[1], items)) for r in rows)))
    assert sorted(map(repr, ((r.doc_id, r.found.n_words, r.found.n_hit, list(r.found["items"])) for r in got))) == want
    assert D.decontaminate(empty, table).count() == 0
    assert D.decontaminate(docs.drop("found"), table.limit(0)).where("found.n_hit > 0").count() == 0


def test_proximity(spark):
    item = words(8, 10)
    near = item.split()
    near[4:4] = ["extra"]
    d = spark.createDataFrame([(1, " ".join(near)), (2, words(9, 30)), (3, item)], "doc_id bigint, text string")
    got = {r.doc_id: r.found for r in D.decontaminate(d, spark.createDataFrame([(5, item)], "item_id bigint, text string"), slop=2).collect()}
    assert (got[1].n_hit, list(got[1].near)) == (0, ["5"]) and list(got[2].near) == [] and (got[3].n_hit, list(got[3].near)) == (10, [])


def brute_groups(rows, n, percent):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    live = [k for k in sets if sets[k] and rows[k][0] is not None]
    for x in live:
        for y in live:
            if y < x and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for k in live:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(map(repr, ((i, len(sets[k]), least[find(k)] if k in root and k in live else i) for k, (i, _) in enumerate(rows))))


@pytest.mark.parametrize("n,percent,block", [(4, 85, 512), (5, 80, 3), (1, 50, 2)])
def test_ngram_join(spark, docs, rows, empty, n, percent, block):
    rng = np.random.default_rng(n)
    base, more = words(11, 80).split(), []
    for k in range(40):
        w = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 5))):
            w[at] = "z%d" % rng.integers(0, 30)
        more.append((100 + k, " ".join(w[:int(rng.integers(60, 81))])))
    for all_rows, d in (([(r[0], r[1]) for r in rows], pick(docs, id="doc_id", text="text")), (more, spark.createDataFrame(more, "id bigint, text string").repartition(4))):
        got = J.jaccard_join(d, n, percent, block).collect()
        assert sorted(map(repr, ((r.id, r.n_shingles, r.component_id) for r in got))) == brute_groups(all_rows, n, percent)
    assert J.jaccard_join(pick(empty, id="doc_id", text="text"), n, percent).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 50)] + [(70, 60), (60, 70), (5, 5), (None, 3)], "a bigint, b bigint")
    from ridgeline.llm.common import shared_folder

    got = {r.node: r.component for r in C.components(e, shared_folder(spark), "t").collect()}
    assert got == {i: 0 for i in range(51)} | {60: 60, 70: 60}


def test_licenses(spark, docs, empty):
    got = {(r.doc_id, r.notices, r.n_notice_lines) for r in LI.scan_licenses(pick(docs, doc_id="doc_id", text="text")).collect() if r.notices}
    assert got == {(15, "reserved", 1), (16, "MIT", 1)}
    mit = next(t for n, t in LI.KNOWN if n == "MIT" and len(t) > 500)
    spelled = "Copyright (c) 2021 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(". ", ".\n\n").replace('"', "'")
    d = spark.createDataFrame([(1, spelled), (2, mit + " more"), (3, None), (4, "Copyright only\n")], "doc_id bigint, text string")
    r = {r.doc_id: r for r in LI.scan_licenses(d).collect()}
    assert r[1].license == "MIT" and r[2].license is None and r[3].digest is None and r[4].digest is None
    assert r[1].digest == hashlib.sha256(LI.canonical(mit).encode()).hexdigest()
    assert LI.scan_licenses(pick(empty, doc_id="doc_id", text="text")).count() == 0


def test_licenses_as_published(spark):
    mit = next(t for n, t in LI.published() if n == "MIT")
    full = {n: t for n, t in reversed(LI.published())}
    wrap = lambda t, mark="": "\n".join(mark + x for p in t.split("\n") for x in textwrap.wrap(p, 61) or [""])
    texts = {
        "MIT": "MIT License\n\nCopyright (c) 2024 Somebody\n\n" + wrap(mit.split("holders>\n\n")[1]),
        "BSD-3-Clause": "// Copyright 2015 The X Authors. All rights reserved.\n\n" + wrap(full["BSD-3-Clause"].split("<owner>")[1], "// ").replace("1.", "*").replace("2.", "*").replace("3.", "*"),
        "ISC": "The ISC License\n\nCopyright X\n" + wrap(full["ISC"].split("ISC License")[1]),
        **{n: full[n] for n in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense", "CC-BY-SA-4.0")}}
    texts |= {n + "/cut": full[n].split("END OF TERMS AND CONDITIONS")[0] for n in ("Apache-2.0", "GPL-3.0-only")}
    code = lambda n: (Path(LI.__file__).parent / "license_texts" / f"{n}~header.txt").read_text()
    longer = {
        "Apache-2.0": "#!/bin/sh\n#\n# Copyright 2020 X\n#\n" + "\n".join("# " + x for x in code("Apache-2.0").splitlines()) + "\n\nset -e\n",
        "GPL-3.0-or-later": "/* a.c\n *\n" + wrap(code("GPL-3.0-or-later"), " * ") + "\n */\nint main;\n",
        "MPL-2.0": "words before\n\n" + wrap(next(t for n, t in LI.KNOWN if n == "MPL-2.0" and len(t) > 99)) + "\n\nwords after",
        "MIT": "A project.\n\n" + texts["MIT"] + "\n\nmore words"}
    rows = [(f"{n}|", t) for n, t in texts.items()] + [(f"{n}|longer", t) for n, t in longer.items()] + [("none", wrap(mit)[:-20] + " other words")]
    got = {r.doc_id: r for r in LI.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {n: got[f"{n}|"].license for n in texts} == {n: n.split("/")[0] for n in texts}
    assert {n: (got[f"{n}|longer"].license, got[f"{n}|longer"].notices, got[f"{n}|longer"].n_notice_lines) for n in longer} == {n: (None, n, 1) for n in longer}
    assert got["none"].license is None and got["none"].notices == ""


RECORD = "record_id bigint, url string, captured_at bigint, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>, body string, latest int"


def test_revisits(spark):
    day, u = W.SPAN, "HTTP://www.Example.org:80/a/?utm_source=x#top"
    r = lambda i, url, at, kind, tag=None, when=None, sha=None, head=None, body=None: (i, url, at, kind, tag, when, sha, head, body, 1)
    rows = [
        r(1, u, 10, "response", '"a"', "mon", "x", {"etag": '"a"', "content-type": "text/html", "expires": "1"}, "one"),
        r(2, "https://example.org/a", 20, "response", '"b"', None, None, {"content-type": "t"}, "two"), r(2, "https://example.org/a", 20, "response", '"b"', None, None, {"content-type": "t"}, "two"),
        r(3, "http://example.org/a/", 15, "revisit", 'W/"a"', None, None, {"expires": "9", "content-type": "no", "date": "d"}),
        r(4, "http://example.org/a/", 5 * day, "revisit", '"b"'), r(5, "http://example.org/a", 5 * day, "revisit", '"c"'), r(6, "http://example.org/a", 10, "revisit", '"a"'),
        r(7, "http://example.org/a", 30, "revisit", None, "mon"), r(8, None, 30, "revisit", '"a"'), r(9, u, None, "revisit", '"a"'), r(10, "http://other.org", 9, "revisit", '"a"'),
        r(11, "http://example.org/a", 16, "revisit", '"zzz"', "mon", "x"), r(4, "http://example.org/a/", 5 * day, "revisit", '"b"')]
    got = W.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    by = {x.record_id: x for x in got}
    assert len(got) == 10
    assert {i: (x.source_id, x.reason) for i, x in by.items()} == {
        3: (1, "resolved"), 4: (2, "resolved"), 5: (None, "validator differs"), 6: (None, "no earlier response"), 7: (None, "no validator"),
        8: (None, "no url"), 9: (None, "no time"), 10: (None, "no earlier response"), 11: (1, "resolved")}
    assert by[3].headers == {"etag": '"a"', "content-type": "text/html", "expires": "9", "date": "d"} and by[3].body == "one" and by[4].body == "two"
    assert W.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


def brute_top(rows, step, k):
    out = []
    for q, v in rows:
        if q % step == 0:
            score = [(-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(score)[:k])]
    return out


@pytest.mark.parametrize("scale,block", [(1, 1000), (300, 100), (100000, 37)])
def test_top_k(spark, scale, block):
    rng = np.random.default_rng(scale)
    rows = [(int(i), [int(x) for x in rng.integers(-scale, scale + 1, 9 if i % 4 else 6)]) for i in rng.permutation(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, [0] * 9)]
    d = spark.createDataFrame(rows, "id bigint, v array<bigint>")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in K.top_k(d, F.col("id") % 20 == 0, 5, block, 4).collect()]
    assert sorted(got) == sorted(brute_top(rows, 20, 5))


def test_top_k_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.5, -0.001]), (None, [1.0, 1.0]), (6, [1e30, 1.0]), (7, []), (5, [0.5, -0.001])]
    d = K.quantised_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding")
    assert sorted((r.id, list(r.v)) for r in d.collect()) == [(0, [256, 512]), (5, [128, -1]), (5, [128, -1]), (7, [])]
    got = [tuple(r) for r in K.top_k(d, F.col("id") % 50 == 0, 5).collect()]
    assert sorted(got) == [(0, 1, 5, 32256), (0, 2, 5, 32256), (0, 3, 7, 0)]
    assert K.top_k(d.limit(0), F.col("id") % 50 == 0, 5).count() == 0 and K.top_k(d.where("id > 0"), F.col("id") % 50 == 0, 5).count() == 0


def test_top_k_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 5)]) for i in range(120)]
    rows += [(200, [6e5, -1.0, 2.0]), (201, [-6e5, 0.5]), (250, [0.0, 1e12, -3e12, 0.25]), (202, [1e7, 1e11, 1e11, 1.0]), (203, [-1e300, 0.0, 0.0]), (204, [0.0, 0.0, 0.0, 0.0, -1e30])]
    vectors = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    d = K.finite_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").where("id not in (203, 204)")
    for block in (1000, 17):
        got = [(r.query_id, r["rank"], r.id, r.score) for r in K.top_k(d, F.col("id") == 50, 5, block, 2).collect()]
        assert sorted(got) == sorted(x for x in brute_top([v for v in vectors if v[0] < 203 or v[0] == 250], 50, 5) if x[0] == 50)
    every = K.finite_vectors(spark.createDataFrame([(i, [1.0, *v[1:]]) if i == 50 else (i, v) for i, v in rows if i != 204], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
    assert 203 not in {r.id for r in K.top_k(every, F.col("id") == 50, 5).collect()}        # its score fits no long, but is not among the best
    with pytest.raises(Exception, match="does not fit a long"):
        K.top_k(every.where("id in (50, 203)"), F.col("id") == 50, 5).collect()


def test_top_k_sums_beyond_64_bits(spark):
    big = (1 << 27) - 1
    rows = [(0, [big] * 1200), (1, [big] * 1100 + [-big] * 100), (2, [-big] * 1200), (3, [1] * 600 + [0] * 600), (4, [big] * 700 + [-big] * 500)]
    found = K.SlicedBlock(np.array([i for i, _ in rows]), np.array([v for _, v in rows]).T).search(0, np.array(rows[0][1]), 3)
    assert [(int(i), int(s)) for i, s in zip(*found, strict=True)] == [(1, 1000 * big * big), (4, 200 * big * big), (3, 600 * big)]


def test_top_k_repeated_queries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, 4)]) for i in range(90)]
    again = [*rows, rows[0], rows[0], (50, [9, -9, 9, -9]), (50, [1 << 40, 0, 0, 1])]
    d = spark.createDataFrame(again, "id bigint, v array<bigint>")
    got = [(r.query_id, r["rank"], r.id, r.score) for r in K.top_k(d, F.col("id") % 50 == 0, 5, 40, 2).collect()]
    queries = [q for n, q in enumerate(again) if q[0] % 50 == 0 and q not in again[:n]]
    expected = []
    for q, v in queries:
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in again if i != q)
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:5])]
    assert len(queries) == 4 and sorted(got) == sorted(expected)
