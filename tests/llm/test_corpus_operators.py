"""The corpus operators on small frames with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import decontamination, jaccard_join, language, line_dedup, mixing, token_counts, toxicity, url_filter, vector_topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), "x") for i, t in zip(ids, texts, strict=True)], DOCS)


# --- 1 ---------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(3)
    parts = ["a", "b", "'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "½", "!", "...", " ", "　", "<|endoftext|>", "\U0001f600", "'s", "'S", "aaaa", "\x85"]
    texts = [None, "", " ", "x" * 40_000, "word " * 5000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += texts[:50]
    df = docs(spark, texts).withColumn("n_tokens", F.lit("clash"))
    out = {r.doc_id: r for r in token_counts.with_token_counts(df, path).collect()}
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit, out[i].extra) == (n, len((t or "").encode()), n > 512, "x")
    assert token_counts.with_token_counts(df.limit(0), path).count() == 0


# --- 2 ---------------------------------------------------------------------------------


def _prose(rng, words=60, bad=()):
    base = ["ing", "tion", "the", "er", "an", "re", "on", "at", "en", "nd"]
    out = ["".join(rng.choice(base) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for w in bad:
        out[rng.randrange(words)] = w
    return " ".join(out)


def test_toxicity_learns_held_out_texts(spark):
    rng = random.Random(1)
    bad = ["grumblefoot", "snarkhole", "dolthead"]
    texts = [_prose(rng, bad=rng.sample(bad, 3) if i % 4 == 0 else ()) for i in range(600)]
    y = np.array([i % 4 == 0 for i in range(600)], int)
    model = toxicity.fit(texts[:400], y[:400])
    frame = docs(spark, texts[400:] + [None, "", "  ", texts[0] * 200, texts[0]]).withColumn("score", F.lit("clash"))
    out = [(r.doc_id, r.score, r.predicted) for r in toxicity.with_toxicity(frame, model).orderBy("doc_id").collect()]
    predicted = np.array([r[2] for r in out[:200]])
    assert (predicted[y[400:] == 1] == 1).mean() >= 0.95 and (predicted[y[400:] == 0] == 0).mean() >= 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in out)
    assert out[200][1] == out[201][1] == out[202][1] < 0.5
    assert toxicity.with_toxicity(frame.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, ["a b", None]), labels)
    assert toxicity.with_toxicity(docs(spark, ["a b", None]), model).filter("predicted = 0").count() == 2


# --- 3 ---------------------------------------------------------------------------------


def _words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contamination(texts, items):
    out = []
    for t in texts:
        w, hit, found = _words(t), set(), set()
        for item, text in items:
            v = _words(text)
            n = min(13, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
        ids = ",".join(sorted(found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefg")  # noqa: E731  few words, so that chance hits and repeats are many
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(12)] + [(None, "Ä b, c d"), (7, "zz zz zz"), (7, "zz zz zz"), (99, None)]
    texts = [None, "", "...", "zz zz zz", "x " * 30 + "zz ZZ-zz"]
    for _ in range(60):
        t = " ".join(rng.choice("hijkl") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.7:
            v = rng.choice(items)[1] or ""
            t += " " + v[rng.randint(0, 6) :] + " " + t
        texts.append(t)
    texts += texts[:6]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, f int")
    out = decontamination.contamination(docs(spark, texts), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out] == _contamination(texts, items)
    plan = decontamination.contamination(docs(spark, texts), bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("which", ["docs", "items"])
def test_contamination_of_empty_tables(spark, which):
    d, b = docs(spark, ["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    if which == "docs":
        assert decontamination.contamination(d.limit(0), b).count() == 0
    else:
        assert decontamination.contamination(d, b.limit(0)).first().n_hit == 0


# --- 4 ---------------------------------------------------------------------------------


def test_url_verdicts(spark):
    rules = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme casino": ("", "", None, "block"), "http://A.Example.COM/en/x?y": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "https://x.com": ("x.com", "", None, "allow"), "https://x.com/?casino": ("x.com", "/", "com/", "allow"),
        "https://net/es/": ("net", "/es/", "net/es/", "block"), "https://anet/es/": ("anet", "/es/", None, "allow"), "http://a.org/casino": ("a.org", "/casino", None, "block"), "http://a.org/casinos": ("a.org", "/casinos", None, "allow"),
        "http://a.org/poker": ("a.org", "/poker", None, "allow"), "http://a.org/poker-poker": ("a.org", "/poker-poker", None, "allow"), "http://a.org/poker-slots": ("a.org", "/poker-slots", None, "block"), "http://a.org#f/casino": ("a.org", "", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    out = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.with_url_verdict(df, rules).collect()}
    assert out == cases
    assert url_filter.with_url_verdict(df.limit(0), rules).count() == 0


# --- 5 ---------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=5).tolist() for _ in range(120)] + [[0.5] * 5] * 40 + [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] * 5, [1e9, -1e9, 0.0, 1.0, 2.0]]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, score int, rank int")
    out = vector_topk.top_k(df, df.filter("vec_id % 7 = 0"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in zip(ids, vectors, strict=True) if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in good if i % 7 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q)[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert vector_topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert vector_topk.top_k(df.limit(2), df.filter("vec_id = 0")).count() == 1


# --- 6 ---------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    htmls = [None, "", "small", "small", big, big, big, other, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\r\n\r\n", "x" * 300_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i else None, h, 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, type int")
    captures = warc.round_trip(pages)
    out = {r.page_id: r for r in warc.digests(captures).collect()}
    assert len(out) == len(htmls)
    for i, h in enumerate(htmls):
        raw = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = i in (4, 5)
        assert (out[i].record_type, out[i].refers_to) == (("revisit", 6) if revisit else ("response", None))
    assert captures.filter("request is null or metadata is null").count() == 0
    bodies = {bytes(r.b) for r in captures.filter("response.type = 'response'").select(F.col("response.body").alias("b")).collect()}
    assert bodies == {(h or "").encode() for h in htmls}
    assert warc.digests(warc.round_trip(pages.limit(0))).count() == 0


# --- 7 ---------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ing", "the", "wh"], "bb": ["sch", "ung", "ei"], "cc": ["ció", "que", "ll"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
    langs = [rng.choice(list(sounds)) for _ in range(500)]
    texts = [text(x) for x in langs]
    model = language.fit(texts[:300], langs[:300])
    df = docs(spark, texts[300:] + [None, "", "123 ...", "the wh" * 30_000]).withColumn("lang_pred", F.lit("clash"))
    out = [(r.lang_pred, r.score) for r in language.with_language(df, model).orderBy("doc_id").collect()]
    assert np.mean([p[0] == want for p, want in zip(out, langs[300:], strict=False)]) > 0.97
    assert out[200:203] == [("und", 0.0)] * 3 and out[203][0] == "aa"
    assert all(0 <= s <= 1 for _, s in out)
    assert language.with_language(df.limit(0), model).count() == 0


def test_language_without_training_rows(spark):
    model = language.train(docs(spark, [None, "a"]).withColumn("lang", F.lit(None).cast("string")))
    assert [r.lang_pred for r in language.with_language(docs(spark, ["abc"]), model).collect()] == ["und"]


# --- 8 ---------------------------------------------------------------------------------


def _components(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def _families(rng, n=40):
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "é ß a b c d"]
    for _ in range(n):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz") * 3
            texts.append(" ".join(t[rng.randint(0, 2) :]))
    passage = " ".join(f"p{i}" for i in range(60))
    return texts + [passage + f" tail{i}" for i in range(25)] + texts[5:9]


def test_components_equal_brute_force(spark):
    texts = _families(random.Random(11))
    out = jaccard_join.similarity_components(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == _components(texts)


def test_components_of_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 10_000)
    texts = _families(random.Random(12), 12)
    out = jaccard_join.similarity_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == _components(texts)


def test_components_of_null_ids_and_no_rows(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [None, 5, 5])
    assert sorted((r.doc_id is None, r.component_id) for r in jaccard_join.similarity_components(df).collect()) == [(False, 5), (False, 5), (True, 5)]
    assert jaccard_join.similarity_components(df.limit(0)).count() == 0


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        base = [rng.integers(0, 60, rng.integers(1, 30)) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(2, 25)):
            b = base[rng.integers(4)]
            sets.append(np.unique(np.where(rng.random(len(b)) < 0.12, rng.integers(0, 80, len(b)), b)))
        n = np.array([len(s) for s in sets])
        want = [(i, j) for i in range(len(sets)) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 75 * (n[i] + n[j] - o)]

        def groups(links, m=len(sets)):
            p = list(range(m))

            def r(i):
                while p[i] != i:
                    i = p[i]
                return i

            for a, b in links:
                p[max(r(a), r(b))] = min(r(a), r(b))
            return [r(i) for i in range(m)]

        assert groups(jaccard_join.trie_links(sets, n)) == groups(want)


# --- 9 ---------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 80))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(1000, None, "a"), (None, "x y", "b"), (1, "x y", "b"), (1, "x y", "b"), (7, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix_sources(df)
    first = sorted(map(str, out.collect()))
    assert first == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    got = out.collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        e = by.setdefault((r.source_size, r.target), [0, 0])
        e[0] += r.taken
        e[1] += r.size
    assert all(abs(taken - target) <= 1 and target <= 2 * size for (size, target), (taken, _) in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * total)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_fitted_counts():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.unique(rng.integers(1, 5000, 60))
        counts = rng.integers(1, 40, len(sizes))
        budget = int((sizes * counts).sum() * rng.random())
        taken = mixing.fit_counts(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and 0 <= budget - (sizes * taken).sum() <= 2


# --- 10 --------------------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _without_lines(texts, edits=2):
    first = {}
    for i, t in enumerate(texts):
        for n, s in enumerate((t or "").split("\n")):
            if len(s.encode()) >= 20:
                first.setdefault(s, (i, n))
    gone = {s for s in first for o in first if first[o] < first[s] and abs(len(o.encode()) - len(s.encode())) <= edits and _distance(o.encode(), s.encode()) <= edits}
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append(None)
            continue
        out.append("\n".join(s for n, s in enumerate(t.split("\n")) if len(s.encode()) < 20 or (first[s] == (i, n) and s not in gone)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.choice([5, 19, 20, 25, 40, 300]))) for _ in range(25)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice([[], ["z"], ["é"]])
        return "".join(s)

    texts = [None, "", "\n\n"] + ["\n".join(changed(rng.choice(pool)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = docs(spark, texts).withColumn("n_dropped", F.lit("clash"))
    out = line_dedup.without_repeated_lines(df.repartition(3)).orderBy("doc_id").collect()
    assert [r.text for r in out] == _without_lines(texts)
    assert all(r.extra == "x" for r in out)
    assert line_dedup.without_repeated_lines(df.limit(0)).count() == 0


def test_large_keys_are_compared_in_squares(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SQUARE", 4)
    monkeypatch.setattr(line_dedup, "WANTED", 3)
    texts = ["the same long beginning of a line " + "abcdefghijklmnop"[i % 16] * 3 + "q" * (i % 3) for i in range(60)]
    out = line_dedup.without_repeated_lines(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in out] == _without_lines(texts)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_band(edits):
    rng = random.Random(edits)
    left = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    right = []
    for a in left:
        b = bytearray(a)
        for _ in range(rng.randint(0, edits + 2)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice([b"", b"a", b"b"])
        right.append(bytes(b))
    assert line_dedup.within(left, right, edits).tolist() == [_distance(a, b) <= edits for a, b in zip(left, right, strict=True)]


# --- the pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    prose = lambda n=60: _prose(rng, n)
    item = prose(30)
    shared = prose(25)
    texts = [prose() for _ in range(40)]
    texts += [texts[0], shared + "\n" + prose(), shared + "\n" + prose(), item + " " + prose(10), None, ""]
    frame = docs(spark, texts).drop("extra")
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    d, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "source_mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, f"file://{tmp_path}").collect(), d.schema)
        assert d.columns == frame.columns
        kept.append({r.doc_id for r in d.collect()})
    everyone = set(range(len(texts)))
    assert kept[0] == everyone
    assert kept[1] == everyone - {40}
    assert {r.doc_id: r.text for r in d.collect()}[42] == texts[42].split("\n")[1]
    assert kept[3] == kept[2] - {43}
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in out} == kept[3]
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
