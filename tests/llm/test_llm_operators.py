"""Brute force, round trips and edge cases of the operators."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest_paths import SF001
from fairaudit.llm import (embed_dedup, langid, licences, lm_score, mixing, near_dedup, packing, pii, quality,
                           token_shards, tokens)


def test_edge_rows_quality(edge_docs):
    out = quality.with_quality(edge_docs).collect()
    assert len(out) == 9
    by = {r["text"]: r for r in out}
    assert by[None]["n_words"] == 0 and by[None]["base_failed"] and by[None]["kept"] is False
    assert by[""]["n_words"] == 0 and by[" \n\t "]["n_words"] == 0
    assert quality.passing(edge_docs.limit(0)).count() == 0


def test_quality_repeats_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (4, 5, 6, 9, 30, 80)] + ["p q r s t u " * 3 + "v w x y z"]
    for r in quality.with_quality(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        w = r["text"].split()
        seen: dict = {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i:i + 5]), []).append(i)
        cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
        assert r["n_repeat_words"] == len(cover)


def test_mixing_rates_and_edges(spark, edge_docs):
    rates = {r["source"]: r for r in mixing.source_rates(edge_docs).collect()}
    assert None in rates and all(abs(r["cdf"][-1] - 1) < 1e-9 for r in rates.values())
    out = mixing.mix(edge_docs, mixing.source_rates(edge_docs, size=20.0)).collect()
    keys = [r["order_key"] for r in out]
    assert out and all(1 <= r["copy"] <= r["n_copies"] for r in out)
    ones = [sorted(k for r, k in zip(out, keys) if r["doc_id"] == 1)]
    assert len(ones[0]) % 2 == 0          # repeated rows draw equal counts
    assert mixing.mix(edge_docs.limit(0), mixing.source_rates(edge_docs.limit(0))).count() == 0
    big = spark.range(4000).selectExpr("id doc_id", "repeat('x', 10) text", "if(id % 4 = 0, 'a', 'b') source")
    got = {r["source"]: r["count"] for r in mixing.mix(big, mixing.source_rates(big, weights={"a": 1, "b": 1})).groupBy("source").count().collect()}
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200


def test_poisson_rates_from_zero_to_thousands(spark):
    import math

    from pyspark.sql import functions as F
    rates = [0.0, 0.3, 40.0, 900.0, 3000.0]
    out = spark.createDataFrame([(r,) for r in rates], "rate double").withColumn("cdf", mixing.poisson_cdf(F.col("rate"))).collect()
    for r in out:
        lam, cdf = r["rate"], r["cdf"]
        want = np.cumsum([math.exp(-lam + (k * math.log(lam) if lam else 0.0 if k == 0 else -math.inf) - math.lgamma(k + 1)) for k in range(len(cdf))])
        assert np.allclose(cdf, want, atol=1e-9) and abs(cdf[-1] - 1) < 1e-9
        assert abs(sum(c <= 0.5 for c in cdf) - lam) <= 1          # the median is near the rate


def test_pii_surrogates(spark, edge_docs):
    texts = ["Mr. John Smith, +1 (743) 555-3824, a.b.19@mail5.example.com 154.127.37.204 4785380592391139",
             "Mrs. Jane Doe MR. JOHN SMITH A.B.19@MAIL5.EXAMPLE.COM 4785-3805-9239-1139 123-45-6789",
             'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and г-жа Анна Петрова', "no 12 entities here"]
    rows = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    a, b, c, d = (r["text"] for r in rows)
    assert d == texts[3] and [r["n_entities"] for r in rows] == [5, 5, 2, 0]
    for bad in ("John", "SMITH", "555-3824", "154.127", "4785380592391139", "24be64", "Петрова", "Jane", "6789", "a.b.19@"):
        assert bad not in a + b + c
    name = re.match(r"Mr\. ([\w ]+),", a)[1]
    assert f"MR. {name.upper()}" in b                                     # coreference, case
    assert re.search(r"\S+@\S+", a)[0].lower() == re.search(r"\S+@\S+", b)[0].lower()
    assert re.search(r"\d{16}", a)[0] == re.search(r"\d{4}(-\d{4}){3}", b)[0].replace("-", "")
    assert re.match(r"\+1 \(\d{3}\) \d{3}-\d{4}", a[a.index("+"):]) and re.search("г-жа [А-Я][а-я]+ [А-Я]", c)
    assert pii.replace_pii(edge_docs).count() == 9 and pii.replace_pii(edge_docs.limit(0)).count() == 0


def test_pii_distinct_and_collisions(spark):
    """Two-digit numbers: the space is crowded, so first draws must collide and be redrawn."""
    ents = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(40)], "kind string, canon string")
    again = {r["canon"]: r["attempt"] for r in pii.redraws(ents).collect()}
    from pyspark.sql import functions as F
    amap = spark.createDataFrame(list(again.items()) or [("", 0)], "canon string, attempt int")
    got = [r["s"] for r in ents.join(amap, "canon", "left").select(
        pii.candidate(F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0))).alias("s")).collect()]
    assert again and len(set(got)) == 40
    digits = spark.range(1000).selectExpr("lpad(cast(id as string), 3, '0') s")
    assert digits.select(pii._permute_digits("k", F.lit("t"), F.col("s")).alias("p")).distinct().count() == 1000


@pytest.mark.parametrize("text", ["it's a Test,yes 'S we're x \x1c z", "ÀÉ ß ΣΑΣ İx é ñ, <|endoftext|> hi", "<|ENDOFTEXT|> a",
                                  "日本 テスト, 5,000.10 a.b., (x),", "", "  ", "a\x85b 　 ﬁ ½ word!! one--two"])
def test_ids_equal_the_tokenizer(text):
    path = tokens.vocabulary_path()
    want = tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode_texts([text, None], path)[0], "<u4").tolist() == want


def test_packing(spark, edge_docs):
    assert packing.pack(edge_docs.limit(0), tokens.vocabulary_path()).count() == 0
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    got = packing.pack(docs, tokens.vocabulary_path()).toPandas()
    g = got.sort_values(["sequence_id", "offset"])
    assert ((g.offset + g.length).groupby(g.sequence_id).shift(1).fillna(0) == g.offset).all()
    total = g.groupby("sequence_id").length.sum()
    assert total.max() <= 4096 and 1 - total.sum() / (4096 * len(total)) < 0.03
    path = tokens.vocabulary_path()
    tok = tokens.tokenizer(path)
    want = []
    for r in docs.collect():
        t = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want += [(r["doc_id"] if r["doc_id"] is not None else -1, s, min(4096, len(t) - s), len(t), zlib.crc32(np.asarray(t[s:s + 4096], "<u4").tobytes()))
                 for s in range(0, len(t), 4096)]
    have = list(zip(got.doc_id.fillna(-1).astype(int), got.start, got.length, got.doc_tokens, got.ids_crc32))
    assert sorted(have) == sorted(want)


def test_nnls_and_plan():
    rng = np.random.default_rng(1)
    a = rng.random((6, 9))
    b = a @ np.array([1, 0, 2, 0, 0, 3, 0, 0, 0.5])
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) < 1e-6
    hist = {n: int(c) for n, c in zip(range(1, 65), rng.integers(0, 50, 64))}
    used: dict = {}
    for count, content in packing.plan(hist, window=64, unit=4, depth=3):
        assert sum(n * m for n, m in content) <= 64
        for n, m in content:
            used[n] = used.get(n, 0) + count * m
    assert used == {n: c for n, c in hist.items() if c}


def test_token_shards_round_trip(spark, edge_docs):
    for n in (1, 2, 3, 17, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n).tolist()) == list(range(n))
    path = tokens.vocabulary_path()
    uri = token_shards.scratch_uri(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    m = token_shards.write_shards(docs, path, uri, seq_len=256, rows=128).toPandas().sort_values("slot").reset_index(drop=True)
    assert (m.slot == np.arange(len(m))).all()
    data = np.concatenate([token_shards.read_shard(uri, s, 128, 256, 128) for s in range(0, len(m), 128)])
    assert [zlib.crc32(x.tobytes()) for x in data] == m.ids_crc32.tolist()
    tok = tokens.tokenizer(path)
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert m.n_ids.sum() == want
    order = m.sort_values("sequence_id").index
    flat = np.concatenate([data[i][:m.n_ids[i]] for i in order])
    assert flat.tolist() == [i for r in docs.collect() for i in tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]]
    assert token_shards.write_shards(docs.limit(0), path, token_shards.scratch_uri(spark)).count() == 0


def test_near_duplicates_brute_force(spark, edge_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").filter("doc_id < 400")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    grams = {i: near_dedup.kmers([t.lower().split()])[0] for i, t in rows.items() if t and t.split()}
    group = {i: i for i in rows}
    for x in grams:
        for y in grams:
            n, m = len(grams[x]), len(grams[y])
            if x < y and min(n, m) >= 0.8 * max(n, m) and near_dedup.similarity(grams[x], grams[y]) >= 0.8:
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = {k: new if v == old else v for k, v in group.items()}
    out = near_dedup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == group
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    edge = near_dedup.near_duplicates(edge_docs).collect()
    assert len(edge) == 9 and sum(r["kept"] for r in edge if r["doc_id"] in (1, 2)) == 1
    assert near_dedup.near_duplicates(edge_docs.limit(0)).count() == 0
    assert near_dedup.deduplicate(edge_docs).columns == edge_docs.columns


def test_near_duplicates_large_group(spark):
    """Copies with one to ten edits: buckets over the pair size, links only to some."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(words)
        for k in rng.choice(150, i % 11, replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    grams = [near_dedup.kmers([t.split()])[0] for _, t in rows]
    group = list(range(120))
    for x in range(120):
        for y in range(x + 1, 120):
            if near_dedup.similarity(grams[x], grams[y]) >= 0.8:
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if v == old else v for v in group]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(out, key=lambda r: r["doc_id"])] == group


def test_embeddings_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(0, s, 8)).tolist(), 1 + i % 2) for i, s in enumerate([0.0, 0.05, 0.1, 0.3, 1.0] * 12)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (103, rows[0][1], None), (None, rows[0][1], 1),
             (104, [1.0, None], 1), (105, rows[0][1], 1), (105, rows[0][1], 1), (106, [], 1), (107, [1.0], 1)]
    out = embed_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    good = {i: (np.array(v), k) for i, v, k in rows if i is not None and v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j, (w, m) in good.items() if j != i and m == k and len(w) == len(v) and embed_dedup.cosine(v[None], w[None])[0] >= 0.98}
             for i, (v, k) in good.items()}
    assert len(out) == len(rows)
    for r in out:
        seen, todo = {r["vec_id"]}, [r["vec_id"]]
        while todo:
            todo = [x for x in set().union(*[links.get(t, set()) for t in todo]) if x not in seen]
            seen.update(todo)
        assert r["n_links"] == len(links.get(r["vec_id"], ()))
        if r["vec_id"] is not None:
            assert r["component_id"] == min(seen) and r["kept"] == (r["vec_id"] == min(seen))


def test_language_model_sums_to_one_and_is_accurate(spark, edge_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    fitted = langid.fit(docs.filter(~langid.held_out()).select("text", "lang"))
    out = langid.predict(docs, fitted).join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    edge = {r["doc_id"]: r for r in langid.predict(edge_docs, fitted).collect()}
    assert edge[3]["lang_pred"] == edge[4]["lang_pred"] == edge[6]["lang_pred"] == "und" and edge[3]["score"] == 0
    assert langid.predict(edge_docs.limit(0), fitted).count() == 0
    none = langid.fit(edge_docs.filter("lang IS NULL").select("text", "lang"))
    assert none is None and {r["lang_pred"] for r in langid.predict(edge_docs, none).collect()} == {"und"}


def test_kneser_ney_by_brute_force():
    """Probabilities after a context, against a direct recursion over counts."""
    from collections import Counter
    texts = ["abab abba", "baba aab", "abc cab"]
    model = langid.Model(["x"], {"x": langid.count_grams(texts)})
    grams = langid.count_grams(texts)
    model.fill({n: grams[n][:3] for n in grams})
    counts = {n: Counter() for n in range(1, langid.ORDER + 1)}
    for t in texts:
        s = " " * (langid.ORDER - 1) + t
        for e in range(langid.ORDER - 1, len(s)):
            for n in counts:
                counts[n][s[e - n + 1:e + 1]] += 1
    value = {langid.ORDER: counts[langid.ORDER]}
    for n in range(langid.ORDER - 1, 0, -1):
        value[n] = Counter({g: max(1, sum(1 for h in counts[n + 1] if h[1:] == g)) for g in counts[n]})
    total = sum(value[1].values())
    spare = langid.DISCOUNT * len(value[1]) / total / (4 * (1 + len(value[1])))

    def p(g: str) -> float:
        n = len(g)
        if n == 1:
            return max(value[1][g] - langid.DISCOUNT, 0) / total + spare if g in value[1] else spare
        ctx = [v for h, v in value[n].items() if h[:-1] == g[:-1]]
        if not ctx:
            return p(g[1:])
        return max(value[n][g] - langid.DISCOUNT, 0) / sum(ctx) + langid.DISCOUNT * len(ctx) / sum(ctx) * p(g[1:])
    for t in ("abba", "cab a", "zab"):
        s = " " * (langid.ORDER - 1) + t
        want = -np.mean([np.log(p(s[e - langid.ORDER + 1:e + 1])) for e in range(langid.ORDER - 1, len(s))])
        assert abs(model.cross_entropy([t])[0][0, 0] - want) < 1e-4


def test_lm_gradient_and_score(spark, edge_docs):
    rng = np.random.default_rng(0)
    net = lm_score.Network.start(rng.integers(0, 9, lm_score.VOCAB).astype(float))
    exact = lm_score.Network(net.flat.astype(np.float64))
    w, y = rng.integers(0, lm_score.VOCAB, (6, 2 * lm_score.SIDE)), rng.integers(0, lm_score.VOCAB, 6)
    grad = lm_score.Network(np.zeros(lm_score.Network.SIZE))
    exact.gradient(w, y, grad)
    for i in rng.choice(np.flatnonzero(grad.flat), 12):
        keep, vals = exact.flat[i], []
        for step in (1e-5, -1e-5):
            exact.flat[i] = keep + step
            vals.append(-exact.log_probs(exact.hidden(w), y).mean())
        exact.flat[i] = keep
        assert abs((vals[0] - vals[1]) / 2e-5 - grad.flat[i]) < 1e-6
    ids, lengths = rng.integers(0, lm_score.VOCAB, 40), np.array([10, 0, 30])
    padded = [[lm_score.PAD] * lm_score.SIDE + x + [lm_score.PAD] * lm_score.SIDE for x in (ids[:10].tolist(), ids[10:].tolist())]
    near = [p[i:i + lm_score.SIDE] + p[i + lm_score.SIDE + 1:i + 2 * lm_score.SIDE + 1] for p in padded for i in range(len(p) - 2 * lm_score.SIDE)]
    want = net.log_probs(net.hidden(np.array(near)), ids)
    assert np.allclose(net.score(ids, lengths), want, atol=1e-3)
    out = {r["doc_id"]: r for r in lm_score.score(edge_docs, lm_score.fit(edge_docs)).collect()}
    assert out[3]["n_tokens"] == 0 and out[3]["mean_log_prob"] is None and out[5]["n_tokens"] == 60_000
    assert out[5]["mean_log_prob"] < 0 and lm_score.score(edge_docs.limit(0), lm_score.fit(edge_docs.limit(0))).count() == 0


def test_lm_words_outside_the_vocabulary_keep_their_counts(spark):
    # more words than the vocabulary holds, and two of one bucket that differ in count
    known = [f"v{i}" for i in range(lm_score.VOCAB - lm_score.RARE)]
    first = "rare0"
    other = next(w for w in (f"rare{i}" for i in range(1, 9999)) if lm_score.rare_id(w) == lm_score.rare_id(first))
    texts = [" ".join(known)] * 9 + [" ".join([first] * 8), other]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted = lm_score.fit(docs)
    assert fitted[2].sum() == 9 and {r["word"]: r["n"] for r in fitted[3].collect()} == {first: 8, other: 1}
    probe = spark.createDataFrame([(1, first), (2, other), (2, other)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["pseudo_log_likelihood"]) for r in lm_score.score(probe, fitted).collect())
    assert len(got) == 3 and got[1] == got[2] and abs(got[0][1] - got[1][1] - np.log(8)) < 1e-9


def test_lm_every_word_is_a_target_once(spark, monkeypatch):
    lengths = np.array([1, 7, 0, 48])
    seen = np.concatenate([lm_score.masked(lengths, r) for r in range(lm_score.ROUNDS)])
    assert sorted(seen.tolist()) == list(range(lengths.sum()))
    # the examples of all rounds, as the tasks report them
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(6)] + [(9, "alone")], "doc_id long, text string")
    counted, plain = [], lm_score.staged

    def counting(df, name):
        out = plain(df, name)
        if name == "lm-copies":
            counted.append(out.agg({"n": "sum"}).first()[0])
        return out
    monkeypatch.setattr(lm_score, "staged", counting)
    monkeypatch.setattr(lm_score, "FAN_IN", 10 ** 6)
    lm_score.fit(docs.coalesce(1))
    assert sum(counted) == 43


def test_lm_gradient_of_many_classes_equals_plain_softmax():
    # large, small and absent classes, and logits that need a shift
    rng = np.random.default_rng(1)
    net = lm_score.Network.start(rng.integers(0, 9, lm_score.VOCAB).astype(float))
    net = lm_score.Network(net.flat.astype(np.float64))
    y = np.concatenate([rng.integers(0, 40, 200), rng.integers(64, 2000, 150), [4000] * 3])
    w = rng.integers(0, lm_score.VOCAB + 1, (len(y), 2 * lm_score.SIDE))
    for big in (1, 300):
        net.wc *= big
        grad = lm_score.Network(rng.normal(size=lm_score.Network.SIZE))         # is overwritten
        net.gradient(w, y, grad)
        h, cls, word = net.hidden(w), y // lm_score.PER_CLASS, y % lm_score.PER_CLASS
        soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
        d = (soft(h @ net.wc + net.bc) - np.eye(lm_score.CLASSES)[cls]) / len(y)
        e = (soft(np.einsum("ij,ikj->ik", h, net.wv[cls]) + net.bv[cls]) - np.eye(lm_score.PER_CLASS)[word]) / len(y)
        wv, bv = np.zeros_like(net.wv), np.zeros_like(net.bv)
        np.add.at(wv, cls, e[:, :, None] * h[:, None])
        np.add.at(bv, cls, e)
        dz = (d @ net.wc.T + np.einsum("ik,ikj->ij", e, net.wv[cls])) * (1 - h * h)
        embed = np.zeros_like(net.embed)
        np.add.at(embed, w.ravel(), (dz @ net.w1.T).reshape(-1, lm_score.DIM))
        for name, want in (("wc", h.T @ d), ("bc", d.sum(0)), ("wv", wv), ("bv", bv), ("b1", dz.sum(0)),
                           ("w1", net.embed[w].reshape(len(y), -1).T @ dz), ("embed", embed)):
            assert np.allclose(getattr(grad, name), want, atol=1e-12), name


def test_lm_words_are_those_of_python():
    import random
    import pyarrow as pa
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "A", "b", "\u0130", "\u03a3", "\xdf",
             "\u201cx\u201d", "...", "|", "\xab", "\x00", "word", "I'M", "\u65e5", "\u200b"]
    texts = [None, "", " "] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    words, n = lm_score.split_words(pa.array(texts, pa.string()))
    want = [lm_score.words_of(t) for t in texts]
    assert n.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    assert lm_score.bare_words(words).to_pylist() == [lm_score.bare(w) for x in want for w in x]


def test_lm_texts_are_cut_twice_and_scores_do_not_depend_on_known(spark, monkeypatch, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 9001}" for j in range(300))) for i in range(60)] + [(99, None), (98, "")]
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm_score, "read_table", lambda *_: docs.withColumn("text", F.udf(seen, "string")("text")))
    got = {}
    for known in (lm_score.KNOWN, 40, 0):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        before = read.value
        got[known] = {r["doc_id"]: r["pseudo_log_likelihood"] for r in lm_score.op4_lm_score(spark, str(tmp_path)).collect()}
        assert read.value - before == 2 * len(rows)
    assert len(got[0]) == len(rows) and all(np.allclose(got[0][i], got[k][i], rtol=1e-9) for k in got for i in got[0])


def test_licences(spark):
    files = [("a", "p/LICENSE", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
             ("b", "p/x/y/code.py", "print(1)"), ("c", "p/x/head.py", "code\nLicensed under the Apache License, Version 2.0.\nmore"),
             ("d", "q/z.py", "nothing"), ("e", "p/x/COPYING.txt", "This work is licensed under the GNU General Public License, version 3"),
             ("f", None, None), ("g", "root.py", ""), ("b", "p/x/y/code.py", "print(1)"), ("h", "q/l.py", "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(files, "file_id string, path string, text string")
    got = [(r["file_id"], r["licence"], r["method"]) for r in licences.scan(df).collect()]
    assert sorted(got, key=str) == sorted([
        ("a", "MIT", "file"), ("b", "GPL-3.0", "inherited"), ("b", "GPL-3.0", "inherited"), ("c", "Apache-2.0", "header"), ("d", None, None),
        ("e", "GPL-3.0", "file"), ("f", None, None), ("g", None, None), ("h", "CC-BY-NC-4.0", "header")], key=str)
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_of_real_texts(spark):
    texts = {k: t for kind, k, t in licences._standards() if kind == "text"}
    owned = {k: t.replace("Sam Rijs, Alex Crichton and contributors", "Jane Doe").replace("2018", "2024") for k, t in texts.items()}
    files = [(f"t{k}", f"{k}/LICENSE", t) for k, t in owned.items()] + [(f"c{k}", f"{k}/deep/code.py", "print(1)") for k in owned]
    files += [(f"d{k}", f"docs/{k}.txt", "\n".join(t.splitlines()[1:])) for k, t in owned.items()]     # recognised by content
    expect = [(f"{p}{k}", k, m) for k in owned for p, m in (("t", "file"), ("c", "inherited"), ("d", "file"))]
    for k, t in licences.NOTICES:
        lines = ["Copyright 2024 Jane Doe", ""] + t.splitlines()
        files.append((f"h{k}", f"src/{k}.py", "\n".join("# " + x for x in lines) + "\n\nimport os\n"))
    for k in licences.SHORT:
        files.append((f"h{k}", f"src/{k}.c", "/*\n" + "\n".join(" * " + x for x in owned[k].splitlines()) + "\n */\n\nint x;\n"))
    prose = "The rights of the people are such that no licence is needed, and the state shall not make any of the laws to the contrary. " * 40
    files += [("p", "other/p.txt", prose)]
    out = {r["file_id"]: (r["licence"], r["method"]) for r in licences.scan(spark.createDataFrame(files, "file_id string, path string, text string")).collect()}
    assert {f: out[f] for f, _, _ in expect} == {f: (k, m) for f, k, m in expect}
    heads = [k for k, _ in licences.NOTICES] + list(licences.SHORT)
    assert {k: out[f"h{k}"][0] for k in heads} == {k: k for k in heads}
    assert out["p"] == (None, None)


def test_dedup_keeps_one_row_of_a_group(spark, edge_docs):
    # repeated rows, null ids and a removed copy that shares its id with a kept row
    out = near_dedup.deduplicate(edge_docs)
    rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    marks = near_dedup.near_duplicates(edge_docs)
    assert out.columns == edge_docs.columns and len(rows) == marks.filter("kept").count()
    assert sum(1 for i, _ in rows if i == 1) == 1 and all(i != 2 for i, _ in rows)
    base = edge_docs.filter("doc_id = 2").first()["text"]
    far = " ".join(f"other{i}" for i in range(30))
    docs = spark.createDataFrame([(None, base), (None, base), (None, base + " again"), (None, far), (7, far + " x y"), (7, base + " end"), (8, "lone words here")],
                                 "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(docs).collect()), key=str) == sorted(
        [(7, base + " end"), (7, far + " x y"), (8, "lone words here")], key=str)
    again = docs.filter("doc_id IS NULL")
    got = [r["text"] for r in near_dedup.deduplicate(again).collect()]
    assert len(got) == 2 and far in got


def test_pii_redraws_until_none_collides(spark, monkeypatch):
    from pyspark.sql import functions as F
    # one name of each length: every attempt settles one person
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("ba",) * 16)
    ents = spark.createDataFrame([("person", f"m name{i}") for i in range(12)], "kind string, canon string")
    again = pii.redraws(ents)
    new = ents.join(again, ["kind", "canon"], "left").select(pii.candidate(F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0))).alias("s"))
    assert new.distinct().count() == 12
    # numbers of which all are in use: the search for a free one ends
    full = spark.range(100).select(F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 2, "0").alias("canon"))
    assert pii.redraws(full).count() == 0


def test_language_id_learns_every_language(spark):
    # more languages than have a full sample, each with letters of its own; some with one text only
    def word(k, i):
        return "".join(chr(0x4E00 + 40 * k + (i * s) % 37) for s in (1, 3, 5))
    rows = [(f"l{k:02}", " ".join(word(k, i + 7 * d) for i in range(30))) for k in range(70) for d in range(1 if k >= 50 else 4)]
    fitted = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert fitted[0].langs == sorted({k for k, _ in rows})
    probe = spark.createDataFrame([(k, " ".join(word(k, i) for i in range(3, 20))) for k in range(70)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(probe, fitted).collect()} == {k: f"l{k:02}" for k in range(70)}


def test_stop_words_bind_only_their_languages(spark):
    russian = " ".join(f"слово{chr(0x430 + i % 32)}{chr(0x430 + i // 32)}" for i in range(120))
    latin = " ".join(f"zork{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    rows = [(1, russian, "ru"), (2, russian, None), (3, latin, "en"), (4, latin, None), (5, latin, "fi"), (6, latin, "en-US"), (7, latin, "und")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["failed_rules"] for r in quality.with_quality(df).collect()}
    assert got == {1: "", 2: "", 3: "stop_words", 4: "stop_words", 5: "", 6: "stop_words", 7: "stop_words"}
    assert {r["failed_rules"] for r in quality.with_quality(df.drop("lang").filter("doc_id <= 2")).collect()} == {""}


def test_lm_many_small_tasks_write_few_files(spark, monkeypatch):
    # each file of a task costs a child process of the executor; only the ids need one per task
    from pathlib import Path
    from urllib.parse import urlparse
    from fairaudit import session
    docs = spark.createDataFrame([(i, f"one two three word{i % 7} five") for i in range(96)], "doc_id long, text string").repartition(24)
    base = Path(urlparse(session.checkpoint_base(spark)).path)
    before = set(base.rglob("part-*"))
    out = lm_score.score(docs, lm_score.fit(docs)).collect()
    assert len(out) == 96 and all(r["mean_log_prob"] < 0 for r in out)
    tables = [p for p in set(base.rglob("part-*")) - before if p.suffix == ".parquet"]
    # the average of each round, and an empty first file where the row is elsewhere
    assert {p.parent.name.rsplit("-", 1)[0] for p in tables} == {"lm-copies"} and len(tables) <= 2 * lm_score.ROUNDS


def test_dedup_large_buckets_are_cut_by_kmers_too(spark, monkeypatch):
    # common k-mers are counted a bounded number of postings at a time
    rng = np.random.default_rng(5)
    grams = [np.sort(rng.choice(60, 40, replace=False)).astype("<u4") for _ in range(9)]
    post = np.concatenate(grams)
    order = np.argsort(post, kind="stable")
    owner = np.repeat(np.arange(9, dtype=np.int32), 40)[order]
    largest, plain = [], np.bincount
    monkeypatch.setattr(near_dedup, "MATCHES", 20)
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: largest.append(len(x)) or plain(x, *a, **k))
    for g in [*grams, np.array([], "<u4"), np.array([99], "<u4")]:
        assert near_dedup.common_kmers(g, post[order], owner, 9).tolist() == [len(np.intersect1d(g, x)) for x in grams]
    assert max(largest) <= 20 + 9
    # few long texts make as many shares as many short ones
    monkeypatch.setattr(near_dedup, "BLOCK_KMERS", 1000)
    rows = spark.createDataFrame([(20, 100), (600, 900), (20, 5001)], "size long, grams long")
    assert [r[0] for r in rows.select(near_dedup._shares("size", "grams", 256)).collect()] == [1, 3, 6]


def test_worker_keeps_the_cache_of_one_kind_of_work():
    texts, path = ["The quick (brown) fox, don't stop."], tokens.vocabulary_path()
    want = tokens.encode_texts(texts, path)
    assert tokens._STATE["cache"]
    h = near_dedup.kmers([texts[0].lower().split()])[0]
    assert near_dedup._WORDS and not tokens._STATE["cache"] and tokens._STATE["tok"] is None
    assert tokens.encode_texts(texts, path) == want
    assert tokens._STATE["cache"] and not near_dedup._WORDS
    assert near_dedup.kmers([texts[0].lower().split()])[0].tolist() == h.tolist()


def test_long_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    from fairaudit import session
    docs = spark.range(0, 3_000, 1, 2).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 1_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    def largest():
        rows = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in rows) == 3_000
        return max(r["size"] for r in rows)
    key = session.ARROW_BYTES_CONF
    assert largest() > 6_000_000
    with session.small_batches(spark):
        assert largest() < 6_000_000
    assert spark.conf.get(key, None) is None and largest() > 6_000_000
    spark.conf.set(key, "2m")
    try:
        with session.small_batches(spark):
            assert spark.conf.get(key) == "2m"
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)

    seen = {}
    write = session.staged

    def staged(df, name):
        seen[name] = spark.conf.get(key, None)
        return write(df, name)
    monkeypatch.setattr(packing, "staged", staged)
    monkeypatch.setattr(session.Scratch, "staged", lambda self, df, name: staged(df, name))
    few = docs.limit(3)
    assert packing.pack(few, tokens.vocabulary_path()).select("doc_id").distinct().count() == 3
    assert near_dedup.deduplicate(few).count() == 3 and near_dedup.near_duplicates(few).count() == 3
    assert seen["pack-pieces"] == seen["omh-sketches"] == seen["omh-known"] == session.ARROW_BYTES
    assert spark.conf.get(key, None) is None
