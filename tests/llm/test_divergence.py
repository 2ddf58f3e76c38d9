"""Source divergence against a plain recount, and its perfect hashes."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from locusframe.llm import divergence as D


def plain(rows, least):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    frequency, count, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        frequency.update({(lang, w) for w in words})
        groups[lang].add(source)
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in frequency.items() if x == lang and n >= least]
        share = lambda n: {w: 1 + 10**9 * (n[w] + 2) // (sum(n.values()) + 2 * len(kept)) for w in kept}
        n = {s: {w: count[lang, s, w] for w in kept} for s in sources}
        p = {s: share(n[s]) for s in sources}
        q = share({w: sum(n[s][w] for s in sources) for w in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            term = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if n[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pair))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(term)[:10])]
    return sorted(out)


def some_rows():
    rng = random.Random(5)
    words = [*"abcdefghij", "Ab", "aB", "é", "日本", "x1y", "don't", "Ä", "ä", "\U0001f600", "z" * 300] + [f"w{'xyz'[i % 3] * (i // 3 + 1)}" for i in range(60)]
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([*(f"s{i}" for i in range(9)), None, ""]), " ".join(rng.choice(words[: rng.randint(1, 80)]) for _ in range(rng.randint(0, 40)))) for _ in range(500)]
    rows += [("en", "hot", "alpha beta " * 20)] * 150 + [("fr", "a", None), ("fr", "b", ""), ("fr", "c", "12 34"), ("xx", "alone", "a b")]
    return rows


@pytest.mark.parametrize(("wave", "sources"), [(48 << 20, 64), (2000, 3)])
def test_divergence_equals_a_plain_recount(spark, monkeypatch, wave, sources):
    monkeypatch.setattr(D, "WAVE_BYTES", wave)
    monkeypatch.setattr(D, "SOURCES", sources)
    rows = some_rows()
    frame = spark.createDataFrame([(*r, 7) for r in rows], "lang string, source string, text string, term int").repartition(5)
    got = D.divergence(frame, least=10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain(rows, 10)
    assert {r[0] for r in want} >= {"en", "de", "", "fr"} and {r[2] for r in want} == {"pair", "term"}
    assert sorted(tuple(r) for r in got.collect()) == want


def test_divergence_of_an_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_perfect_hash_gives_each_key_its_own_slot():
    for n in (0, 1, 2, 1000, 20_000):
        keys = pa.array([f"key{i}é" for i in range(n)], pa.large_string())
        h = D.PerfectHash(D.perfect_hash(keys))
        assert sorted(h.slots(keys).tolist()) == list(range(n))
        assert h.keys.take(pa.array(h.slots(keys))).to_pylist() == keys.to_pylist()
        others = pa.array([f"other{i}" for i in range(500)] + [""], pa.large_string())
        assert set(h.slots(others).tolist()) == {-1}


def test_shares_are_exact_beyond_64_bits():
    import numpy as np

    assert D.shares(np.array([3, 10**12]), np.array([10**13, 10**13]), 5).tolist() == [1 + 10**9 * 5 // (10**13 + 10), 1 + 10**9 * (10**12 + 2) // (10**13 + 10)]
