"""Token alignment against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locusframe.llm import token_alignment as TA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(libraries, texts):
    """The contract, token by token."""
    a, b = libraries
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(printable))}
    per_text = []
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            per_text.append(([], [], []))
            continue
        groups, links, i, j, at, bt, g = [], [], 0, 0, 0, 0, ([], [])
        while i < len(x) and j < len(y):
            links.append((x[i], y[j]))
            end_a, end_b = at + len(bytes_a[i]), bt + len(bytes_b[j])
            if end_a <= end_b:
                g[0].append(x[i])
                at, i = end_a, i + 1
            if end_b <= end_a:
                g[1].append(y[j])
                bt, j = end_b, j + 1
            if end_a == end_b:
                groups.append(g)
                g = ([], [])
        per_text.append((groups, links, (len(x), len(y))))
    count = Counter(p for _, links, _ in per_text for p in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for groups, links, n in per_text:
        if not groups:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((*n, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def some_texts():
    rng = random.Random(8)
    parts = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "½", "!", "...", "　", "<|endoftext|>", "<s>", "▁", "\U0001f600", "'s", "aaaa", "tion", "The ", " of the", "é", "\x00", "ﬁ"]
    texts = [None, "", " ", "   ", "x" * 3000, "word " * 900, "▁", "a▁b"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(parts) for _ in range(3000)), *texts[:40]]
    return texts


@pytest.mark.parametrize(("piece_ends", "wave_pairs"), [(1 << 16, 1 << 22), (7, 300), (3, 1 << 22), (64, 1 << 22)])
def test_alignment_equals_a_plain_walk(spark, libraries, piece_ends, wave_pairs):
    texts = some_texts()
    frame = spark.createDataFrame([(i if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_a long").repartition(3)
    want = sorted(((i if i % 9 else -1), *r) for i, r in enumerate(plain(libraries, texts)))
    got = TA.align(frame, A, B, piece_ends=piece_ends, wave_pairs=wave_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in got.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect()) == want
    assert all(r[4] == r[1] + r[2] - r[3] for r in want)


def test_alignment_of_an_empty_table(spark):
    assert TA.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    assert [tuple(r) for r in TA.align(spark.createDataFrame([(None, None)], "doc_id long, text string"), A, B).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_merge_path_keeps_equal_ends_together():
    rng = np.random.default_rng(2)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(0, total), replace=False)) if total > 1 else np.zeros(0, int), total) for _ in range(2))
        i, j = TA.cuts(a, b, int(rng.integers(1, 9)))
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b))
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
        for x, y in zip(i[1:-1], j[1:-1], strict=True):  # all ends before the cut are below all behind it
            before, behind = [*a[:x], *b[:y]], [*a[x:], *b[y:]]
            assert not before or not behind or max(before) < min(behind)
