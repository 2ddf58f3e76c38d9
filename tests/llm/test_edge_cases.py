"""Edge cases of the corpus operators and the pipeline's stages: repeated rows, ties, null ids, clashing names, large values."""

import io
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusframe.llm import _components, _common, jaccard_join, language, line_dedup, mixing, token_counts, toxicity, url_filter, vector_topk, warc

from test_corpus_operators import _components as brute_components, _prose, docs


def _toxic_texts(rng, n, bad=("grumblefoot", "snarkhole", "dolthead")):
    return [_prose(rng, bad=rng.sample(bad, 3) if i % 4 == 0 else ()) for i in range(n)]


def test_toxicity_of_ids_with_both_labels_and_repeated_ids(spark, monkeypatch):
    """An id is toxic if any of its labels says so; all rows of an id count; long rows are used in slices; reruns agree."""
    monkeypatch.setattr(toxicity, "FIT_CHARS", 400)
    rng = random.Random(7)
    texts = _toxic_texts(rng, 240)
    frame = docs(spark, texts + [texts[0], None, ""], [*range(240), 0, None, 240])
    rows = [(i, int(i % 4 == 0)) for i in range(240)] + [(0, 0), (4, 0), (None, 1), (1, None)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    one, two = toxicity.train(frame, labels), toxicity.train(frame.repartition(5), labels.repartition(3))
    assert one.ordinary == two.ordinary and one.toxic == two.toxic and np.array_equal(one.weights, two.weights)
    fresh = _toxic_texts(rng, 100)
    out = toxicity.with_toxicity(docs(spark, fresh).withColumnRenamed("extra", "PREDICTED"), one)
    assert [c.lower() for c in out.columns].count("predicted") == 1
    found = {r.doc_id: r.predicted for r in out.collect()}
    assert sum(found[i] == int(i % 4 == 0) for i in found) >= 95


def test_toxic_words_that_ordinary_texts_hold_too(spark):
    """A beginning that clean texts hold once counts where it is frequent."""
    rng = random.Random(3)

    def text(toxic):
        words = _prose(rng, 80).split()
        for _ in range(rng.randint(3, 6) if toxic else int(rng.random() < 0.1)):
            words.insert(rng.randrange(len(words)), "grom" + rng.choice(["ing", "tion", "the", "er", "an"]) + rng.choice(["ing", "er", "at"]))
        return " ".join(words)

    y = np.array([i % 5 == 0 for i in range(800)], int)
    texts = [text(t) for t in y]
    model = toxicity.fit(texts[:600], y[:600])
    import pyarrow as pa

    predicted = model.score(pa.array(texts[600:])) >= 0.5
    assert predicted[y[600:] == 1].mean() >= 0.9 and (~predicted[y[600:] == 0]).mean() >= 0.9


def test_url_weights_repeated_rows_and_ties(spark):
    rules = (("block", "a.com/x"), ("allow", "a.com/x"))  # equally long: the one listed first
    frame = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/ab-cd"), (3, "http://b.org/ab-ab"), (4, "http://b.org/AB.ef")], "page_id long, url string")
    out = url_filter.with_url_verdict(frame, rules, vocabulary={"ab": 1, "cd": 1, "ef": 2}, limit=2)
    assert sorted((r.page_id, r.verdict) for r in out.collect()) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block")]
    assert url_filter.with_url_verdict(frame, (), vocabulary={}).filter("verdict = 'block'").count() == 0


def test_topk_of_large_and_short_vectors_and_ties(spark):
    """Scores stop at the ends of a long; shorter vectors are padded; ties go to the smaller id."""
    vectors = [[1e16, 0.0], [1e16, 1.0], [-1e16], [0.5], [0.5], [0.0, 2.0], [1e16]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    ints = [[min(max(int(np.floor(256 * x)), -(2**61)), 2**61) for x in [*v, 0.0][:2]] for v in vectors]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), -(2**63)), 2**63 - 1)
    want = {(q, n + 1): (c, s) for q in range(7) for n, (s, c) in enumerate([(-s, c) for s, c in sorted((-score(q, c), c) for c in range(7) if c != q)[:3]])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_topk.top_k(frame, frame, k=3).collect()} == want


def test_topk_does_not_broadcast_the_queries(spark, monkeypatch):
    """Query blocks go to every group of candidates; all these copies would pass through the driver."""
    plans = {}

    def stored(df, keep=vector_topk.stored):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df)

    monkeypatch.setattr(vector_topk, "stored", stored)
    frame = spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.sin(F.col("id") * (i + 1))).alias("embedding"))
    assert vector_topk.top_k(frame, frame.filter("vec_id % 10 = 0")).count() == 100
    scan = plans["ask", "block", "lower", "at", "upper"]
    assert "SortMergeJoin" in scan and "Broadcast" not in scan


def test_topk_of_clustered_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_topk, "BLOCK", 16)
    monkeypatch.setattr(vector_topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vector_topk, "FIRST", 1)
    rng = np.random.default_rng(4)
    vectors = [(rng.normal(size=6) * 0.05 + (i % 3)).tolist() for i in range(150)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    exact = np.floor(256 * np.array(vectors)).astype(np.int64)
    want = {(q, n + 1): (c, -s) for q in range(0, 150, 10) for n, (s, c) in enumerate(sorted((-int(exact[q] @ exact[c]), c) for c in range(150) if c != q)[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vector_topk.top_k(frame, frame.filter("vec_id % 10 = 0")).collect()} == want


def test_warc_archives_that_are_empty_cut_off_or_foreign():
    assert list(warc.parse(io.BytesIO(b""))) == []
    record = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(h["type"], b) for h, b in warc.parse(io.BytesIO(record + record))] == [("warcinfo", b"abc")] * 2
    for bad in (record[:-6], b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", record[:20]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 18)
    htmls = ["x" * 10] * 20 + ["y" * 200_000 + str(i) for i in range(4)] + ["z" * 3_000_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    path = _common.shared_dir(spark)
    warc.write_captures(pages, path)
    import gzip

    sizes = [len(gzip.decompress(bytes(r.content))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    assert sum(s > 1 << 19 for s in sizes) == 1
    assert {r.page_id: r.payload_bytes for r in warc.digests(warc.assemble(warc.read_records(spark, path))).collect()} == {i: len(h) for i, h in enumerate(htmls)}


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than rows that are wanted: one row of each is trained on and none kept back."""
    monkeypatch.setattr(language, "FIT_TOTAL", 60)
    seen = []
    monkeypatch.setattr(language, "_bag", lambda piece, real=language._bag: seen.append(piece) or real(piece))
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(i, f"{n} " * 20, n) for i, n in enumerate(names)] + [(i + 300, f"{n} " * 21, n) for i, n in enumerate(names[:50])]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == names
    model = language.fit([r[1] for r in rows[:300]], [r[2] for r in rows[:300]], epochs=1)
    assert model.langs == names and {p[:4].decode() for p in seen} >= set(names)


def test_language_of_many_languages_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_TOTAL", 60)
    monkeypatch.setattr(language, "FIT_CHARS", 80)
    rng = random.Random(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    text = lambda i: " ".join(alphabet[i] * 2 + alphabet[(i + 1) % 26] + rng.choice("xyz") for _ in range(30))
    frame = spark.createDataFrame([(i, text(i % 26), alphabet[i % 26]) for i in range(780)], "doc_id long, text string, lang string")
    model = language.train(frame)
    assert model.langs == sorted(alphabet)
    twice = docs(spark, ["aab aab aab", "aab aab aab"], [1, 1])
    assert len({(r.lang_pred, r.score) for r in language.with_language(twice, model).collect()}) == 1


def test_chained_passages_are_compared_by_key(spark, monkeypatch):
    """Documents of recurring passages chain, though few are alike; the groups are those of single runs."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rng = random.Random(2)
    pool = [" ".join(f"{a}{i}w{j}" for j in range(15)) for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")]
    texts = [" ".join(rng.sample(pool, 5)) for _ in range(80)]
    texts += [t.replace("w3", "w3x", 1) for t in texts[:15]] + texts[:5] + [None, "a b"]
    out = jaccard_join.similarity_components(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == brute_components(texts)


def test_components_of_nulls_loops_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(_components, "HUB_EDGES", 3)
    edges = [(i, 0) for i in range(1, 30)] + [(i, i + 100) for i in range(30, 40)] + [(i + 100, i + 101) for i in range(30, 39)] + [(None, 1), (2, None), (5, 5)]
    out = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 30)} | {i: 30 for i in [*range(31, 40), *range(130, 140)]}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(_components, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        _components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))


@pytest.mark.parametrize("sizes, counts, budget", [([180_000, 190_000], [1, 1], 200_000), ([100_000, 101_000], [2, 1], 130_000), ([70_000, 90_000, 5], [4, 2, 3], 300_000), ([65_537], [9], 600_000), ([1, 200_000], [10, 3], 150_000)])
def test_budgets_of_documents_beyond_the_knapsack(sizes, counts, budget):
    """No document that is left would still fit, whatever its length."""
    sizes, counts = np.array(sizes), np.array(counts)
    taken = mixing.fit_counts(sizes, counts, budget)
    words = int((sizes * taken).sum())
    assert (taken <= counts).all() and words <= budget
    assert all(words + s > min(budget, (sizes * counts).sum()) for s, c, t in zip(sizes, counts, taken, strict=True) if c > t)


def test_small_budgets_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = np.unique(rng.integers(1, 40, 4))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        best = max(t for n in itertools.product(*[range(c + 1) for c in counts]) if (t := int((sizes * n).sum())) <= budget)
        got = int((sizes * mixing.fit_counts(sizes, counts, budget)).sum())
        assert got == best


def test_line_dedup_of_null_ids_and_own_names(spark):
    line = "a line that is long enough to be told apart"
    frame = spark.createDataFrame([(None, line, 1, "k"), (3, line, 2, "l"), (3, f"{line}\nx", 3, "m"), (4, None, 4, "n")], "doc_id long, text string, `__id` int, N_Lines string")
    out = line_dedup.without_repeated_lines(frame).collect()
    assert sorted((r["__id"], r.text) for r in out) == [(1, ""), (2, line), (3, f"{line}\nx"), (4, None)]
    assert [c.lower() for c in out[0].__fields__].count("n_lines") == 1


def test_pipeline_stages_keep_rows_and_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(5)
    a, b, item = _prose(rng, 60), _prose(rng, 60), _prose(rng, 30)
    rows = [(1, a, "s", "p", 7), (5, a, "t", "q", 8), (5, b, "u", "r", 9), (5, b, "u", "r", 9), (None, a, "v", "x", 1), (None, item, "w", "y", 2), (6, None, None, None, None), (7, "", "z", "z", 3), (7, "", "z", "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, `__key` string, n_lines int")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    at = lambda stage: sorted(map(str, stage(spark, frame, f"file://{tmp_path}").select(*frame.columns).collect()))
    strings = lambda keep: sorted(map(str, spark.createDataFrame([r for i, r in enumerate(rows) if i in keep], frame.schema).collect()))
    assert at(P.drop_toxic) == strings(range(9))
    assert at(P.drop_near_copies) == strings([0, 2, 5, 6, 7, 8])
    assert at(P.drop_contaminated) == strings([0, 1, 2, 3, 4, 6, 7, 8])
    assert at(P.drop_repeated_lines) == strings([0, 2, 3, 5, 6, 7, 8])
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, frame.limit(0), f"file://{tmp_path}").count() == 0
    assert P.mix(spark, frame.withColumn("source", F.lit(None).cast("string")), "").count() == 9


def test_mix_of_long_documents():
    assert mixing.fit_counts(np.array([100_000, 101_000]), np.array([1, 1]), 130_000).tolist() == [0, 1]
    rng = np.random.default_rng(3)
    for low in (1, 20_000, 40_000, 65_000, 70_000):
        for _ in range(20):
            sizes = np.unique(rng.integers(low, 400_000, 6))
            counts = rng.integers(1, 4, len(sizes))
            budget = int((sizes * counts).sum() * rng.random())
            taken = mixing.fit_counts(sizes, counts, budget)
            miss = budget - int((sizes * taken).sum())
            assert (taken >= 0).all() and (taken <= counts).all() and 0 <= miss
            assert not (taken < counts).any() or miss < sizes[taken < counts].min()


def test_pipeline_drops_reach_every_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda n=60: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    item, copied, single, other = prose(30), prose(), prose(), prose()
    near = copied + " end"
    bad = item + " " + prose(5)
    rows = [(5, copied), (3, near), (None, copied), (7, single), (7, single), (8, other), (None, prose()), (None, ""), (None, ""), (9, None)]
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    frame.write.parquet(f"file://{tmp_path}/a")
    got = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"file://{tmp_path}/a"), "").collect()
    want = [(3, near), (7, single), (8, other), rows[6], (None, ""), (None, ""), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = [(None, bad), (4, bad), (4, single), (None, other)]
    frame = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.drop_contaminated(spark, frame, f"file://{tmp_path}").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows[2:], key=str)


def test_warc_ids_come_from_the_rows(spark, tmp_path):
    """Rows in another order give the same records, so a second evaluation of a lost part changes nothing."""
    htmls = ["a" * 1500, "b" * 1500, "short", None, "é" * 900]
    rows = [(i % 23 if i % 7 else None, f"http://h{i % 3}/" if i % 5 else None, htmls[i % 5]) for i in range(60)]
    rows += rows[:6]
    form, path = "page_id long, url string, html string", f"file://{tmp_path}/w"
    warc.write_captures(spark.createDataFrame(rows, form).repartition(3), path)
    records = warc.read_records(spark, path)
    once = sorted(map(str, records.collect()))
    assert len(once) == 3 * len(rows) and records.select("record_id").distinct().count() == 3 * len(rows)
    own = {r.record_id: r for r in records.filter("type = 'response'").collect()}
    revisits = records.filter("type = 'revisit'").collect()
    assert revisits and all(own[r.refers_to].payload_digest == r.payload_digest for r in revisits)
    warc.write_captures(spark.createDataFrame(rows[::-1], form).repartition(5), path)
    assert sorted(set(map(str, warc.read_records(spark, path).collect()))) == once
    assert warc.assemble(warc.read_records(spark, path)).count() == len(rows)


def test_vectors_left_open_do_not_grow_with_the_blocks(monkeypatch):
    """The bound of all blocks so far rules out later vectors, and earlier ones at the end."""
    rng, k = np.random.default_rng(3), 5
    vectors, queries = rng.integers(-200, 200, (6000, 16)), rng.integers(-200, 200, (20, 16))
    scores = queries @ vectors.T
    sizes = {}
    for n in (10, 60):
        state = vector_topk.Open({"ask": np.arange(20), "ids": np.arange(20), "exact": queries}, k)
        for held in (1 << 21, 500):
            monkeypatch.setattr(vector_topk, "HELD", held)
        places = {}
        for i in range(n):
            own = np.arange(i * 100, i * 100 + 100)
            places[str(i)] = np.arange(100)
            state.add(str(i), {"ids": own, **vector_topk.cells_of(vectors[own])})
        got = {q: set() for q in range(20)}
        lower = {q: 0 for q in range(20)}
        for ask, block, low, at, _ in state.rows(places):
            got[ask] |= set((int(block) * 100 + at).tolist())
            lower[ask] += len(low)
        for q in range(20):
            others = [i for i in range(n * 100) if i != q]
            assert got[q] >= set(sorted(others, key=lambda i: -scores[q, i])[:k]) and lower[q] == k and q not in got[q]
        sizes[n] = sum(map(len, got.values()))
    assert sizes[60] < 2 * sizes[10]


def test_token_counts_of_long_words(monkeypatch):
    """Unbroken words are merged rank by rank; short texts through the same code equal the library too."""
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    library = Tokenizer.from_file(path)
    number = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(100_000)), "a" * 9001, "ab" * 3000, "é" * 2000, "aab" * 999 + "b", "日本語" * 700]
    began = time.perf_counter()
    assert token_counts.count_texts(pa.array([" ".join(words), *words]), path).tolist() == [number(" ".join(words)), *map(number, words)]
    assert time.perf_counter() - began < 20
    monkeypatch.setattr(token_counts, "LONG", 1)
    monkeypatch.setattr(token_counts, "_STATE", {})
    texts = ["".join(rng.choice(["a", "b", "the", "ing", "é", "日", " ", "1", "!", "aa"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    assert token_counts.count_texts(pa.array(texts), path).tolist() == list(map(number, texts))
