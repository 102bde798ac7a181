"""The source audit against Python's own whole numbers."""

import re
from collections import Counter, defaultdict

from ridgeline.llm import divergence as D
from ridgeline.llm.common import shared_folder


def brute(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    held, n, groups = defaultdict(set), defaultdict(Counter), {r[:2] for r in rows}
    for i, (lang, source, text) in enumerate(rows):
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)):
            held[lang, t].add(i)
            n[lang, source][t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (x, t), d in held.items() if x == lang and len(d) >= least]
        mine = sorted(s for x, s in groups if x == lang)
        whole = Counter({t: sum(n[lang, s][t] for s in mine) for t in kept})

        def p(c, t, kept=kept):
            return 1 + D.SCALE * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        c = n[lang, source]
        pairs = [(s, sum(f(p(c, t), p(n[lang, s], t)) for t in kept)) for s in mine if s != source]
        terms = [(t, f(p(c, t), p(whole, t))) for t in kept if c[t] and p(c, t) > p(whole, t)]
        for part, found, to in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:to]
            out += [(lang, source, part, item, v, k + 1) for k, (item, v) in enumerate(ranked)]
    return sorted(out)


ROWS = [(lang, f"s{i % 5}", f"Red red{'  Blau' * (i % 3)} grün_{i % 4} x{i % 2}y Ünder ünder {'zz ' * (i % 7)}") for i in range(60) for lang in ("en", "de")]
ROWS += [(None, None, None), (None, "only", "word"), ("", "b", ""), ("en", None, "red blau"), ("en", "s1", None), ("en", "bare", "!!! 123"),
         ("fr", "s0", "tout seul"), ("fr", "s1", None), ("de", "long", "lang " * 40000 + "red"), ("en", "s0", "Red red"), ("en", "s0", "Red red")]


def audit(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "lang string, source string, text string, rank int, part string, n bigint").repartition(5)
    return sorted(tuple(r) for r in D.divergence_audit(df, shared_folder(spark), **kw).collect())


def test_divergences(spark):
    assert audit(spark, ROWS) == brute(ROWS, 10, 10)


def test_divergences_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(D, "SHARD_ROWS", 4)
    assert audit(spark, ROWS, min_documents=1, top=3) == brute(ROWS, 1, 3)


def test_divergences_of_nothing(spark):
    assert audit(spark, []) == []


def test_a_task_sends_on_what_it_cannot_hold(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD_ROWS", 6)
    monkeypatch.setattr(D, "SLICE_BYTES", 64)
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*[[v or "" for v in r] for r in ROWS], strict=True)], ["lang", "source", "text"])
    out = pa.Table.from_batches(list(D.count_batches(iter([batch, batch.slice(0, 0), batch.slice(3, 30)]))))
    n = Counter()
    for r in out.to_pylist():
        n[r["lang"], r["source"], r["term"]] += r["n"]
    whole = pa.concat_tables([D.batch_counts(batch), D.batch_counts(batch.slice(3, 30))]).to_pylist()
    want = Counter()
    for r in whole:
        want[r["lang"], r["source"], r["term"]] += r["n"]
    assert n == want and out.num_rows > len(want)
