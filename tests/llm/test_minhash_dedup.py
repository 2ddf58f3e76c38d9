"""MinHash near-dedup against all pairs of sets, and its sketches against known similarities."""

import random
import re

import numpy as np
import pytest

from locusframe.llm import _groups, minhash_dedup as M


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(len(words) - 1, 1))} if words else set()


def plain(rows, share=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    component = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, component, strict=True)), key=repr)


def some_rows(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE two", "a b c d e", "a b c d e f", "a b c d", "  a b c d e"]
    for size in (5, 6, 12, 40, 300):
        for changed in (0.0, 0.02, 0.05, 0.1, 0.15):
            first = [word() for _ in range(size)]
            texts += [" ".join(word() if rng.random() < changed else w for w in first) for _ in range(6)]
    base = [word() for _ in range(120)]
    for i in range(60):  # a chain of neighbours
        base = base[2:] + [word(), word()]
        texts.append(" ".join(base))
    texts += [texts[40].upper(), texts[40] + " \n", *texts[60:64], "long " * 5000, " ".join(str(i % 700) for i in range(30_000))]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    return [*rows, (None, texts[70]), (None, "alone of its kind here now"), rows[50], rows[50]]


@pytest.mark.parametrize(("members", "bucket"), [(256, 512), (4, 512), (5, 3)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, members, bucket):
    monkeypatch.setattr(_groups, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(_groups, "PIVOTS", 2 if members < 256 else 12)
    monkeypatch.setattr(M, "BUCKET", bucket)
    rows = some_rows(random.Random(members))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sig string").repartition(3)
    got = M.near_duplicates(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_a_dense_group_below_the_threshold(spark, monkeypatch):
    """Sets of similarity 0.7 or so with few links among them: no link is lost, and none made."""
    monkeypatch.setattr(_groups, "BLOCK_MEMBERS", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.08 else w for w in base) for _ in range(120)]
    rows = list(enumerate(texts))
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in M.near_duplicates(spark.createDataFrame([(None, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(None, 0, None, True), (3, 0, 3, True)]
    with pytest.raises(ValueError):
        M.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), share=60)


def test_sketches_estimate_similarities():
    rng = np.random.default_rng(1)
    for true in (0.5, 0.8, 0.95):
        estimates, shared = [], []
        for _ in range(300):
            n = 400
            both = int(round(2 * n * true / (1 + true)))
            pool = rng.integers(1, 2**63, 2 * n - both, dtype=np.uint64)
            least = M.min_hashes(np.concatenate([pool[:n], pool[n - both :]]), np.array([n, n]))
            x = M.odd_sketches(least)
            estimates.append(M.similarity(int(M._bits(x[0] ^ x[1]))))
            keys = M.band_keys(least)
            shared.append(float((keys[0] == keys[1]).mean()))
        assert abs(np.mean(estimates) - true) < 0.02 and np.std(estimates) < 0.08
        assert abs(np.mean(shared) - true**M.ROWS) < 0.05
