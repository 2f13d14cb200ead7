"""The ten operators against brute force on small fixtures, and their edge cases.

Edge cases everywhere: nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and extra
columns with clashing names.
"""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import graph, langid, lmscore, minhash, mixing, packing, pii, quality, queries, textops, tokens, topk, urls, vecdedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<float>, label int"
LONG = "word " * 200_000


def docs(spark, texts, ids=None, lang="en", source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in zip(ids, texts, strict=True)], DOC)


# --- text primitives ------------------------------------------------------------------------------------------------


def test_words_and_shingles_match_a_plain_split():
    texts = ["The cat sat on the mat", "", None, "  a\tb\nc  ", "x", "é ü the cat sat on", LONG[:5000]]
    w = textops.Words(*textops.buffers(pa.array(texts)))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert w.counts.tolist() == [len(p) for p in plain]
    by_word = collections.defaultdict(set)
    for p, h in zip([x for p in plain for x in p], w.hash.tolist(), strict=True):
        by_word[p].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({next(iter(v)) for v in by_word.values()}) == len(by_word)
    value, at = textops.distinct_by_doc(*textops.shingles(w, 4), w.docs)
    sets = [len({tuple(p[i : i + 4]) for i in range(len(p) - 3)}) if len(p) >= 4 else int(bool(p)) for p in plain]
    assert np.diff(at).tolist() == sets


def test_lookup_table_finds_all_and_nothing_else():
    keys = np.unique(np.random.RandomState(0).randint(0, 2**62, 5000).astype(np.uint64))
    m = textops.VecMap(keys)
    assert (m.get(keys) == np.arange(len(keys))).all()
    assert (m.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert textops.VecMap(keys[:0]).get(keys[:3]).tolist() == [-1] * 3


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 40)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert all(found[i] == 0 for i in range(31)) and found[101] == 100 and all(found[200 + i] == 200 for i in range(40))


# --- op1 ------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, VEC)


@pytest.mark.parametrize("dimension", [1, 6, 64])
def test_top_k_matches_brute_force(spark, dimension):
    rng = np.random.RandomState(dimension)
    m = rng.normal(0, 1, (400, dimension)).astype(np.float32)
    m[50:80] = m[0]  # ties
    v = topk.quantised(vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(m)]))
    got = collections.defaultdict(list)
    for r in topk.top_k(v.where("vec_id % 50 = 0"), v, topk.Params(block=3, seeds=20, rows=64)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    q = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    for i in range(0, 400, 50):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(400), -score)) if j != i][:5]
        assert got[i] == [(k + 1, j, score[j]) for k, j in enumerate(order)]


def test_top_k_edge_cases(spark):
    bad = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [], 1), (None, [1.0, 1.0], 1), (50, [0.5, 0.5], None), (51, [1.0], 1), (0, [2.0, 0.0], 1)]
    d = vectors(spark, bad).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    v = topk.quantised(d)
    found = topk.top_k(v.where("vec_id % 50 = 0"), v)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert {r["vec_id"] for r in found.collect()} <= {0, 50}
    none = topk.quantised(d.limit(0))
    assert topk.top_k(none, none).collect() == []


def test_top_k_of_huge_components_and_repeated_ids(spark):
    rows = [(0, [2**33 + 1, 3]), (1, [2**29 + 1, 1]), (2, [2**29, 7]), (3, [2**29 + 1, 1]), (3, [5, 5])]
    v = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(v.where("vec_id = 0"), v, topk.Params(k=4)).orderBy("rank").collect()]
    want = sorted(((sum(a * b for a, b in zip(rows[0][1], x, strict=True)), -i) for i, x in rows[1:]), reverse=True)
    assert got == [(-i, s) for s, i in want]
    many = topk.quantised(vectors(spark, [(i, [float(i % 7), float(i % 5)], 0) for i in range(60)]))
    a, b = (sorted(map(tuple, topk.top_k(many, many, p).collect())) for p in (topk.Params(block=4, blocks=2), topk.Params()))
    assert a == b and len(a) == 300


def test_bounds_never_cut_a_better_row():
    rng = np.random.RandomState(5)
    m, q = rng.normal(0, 50, (300, 32)).round(), rng.normal(0, 50, (9, 32)).round()
    exact = q @ m.T
    for (qm, qd, _), (rm, rd, _) in zip(topk.statistics(q), topk.statistics(m), strict=True):
        assert (qm @ rm.T + qd @ rd.T >= exact - 1e-6).all()


# --- op2 ------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.93):
    ok = {i: (np.array(e, float), lab) for i, e, lab in rows if e is not None and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    links = collections.defaultdict(set)
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b), links[b].add(a)
    return links


def reach(ids, links):
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += links[x]
    return out


def test_vector_dedup_recall_and_precision(spark):
    rng = np.random.RandomState(1)
    base = rng.normal(0, 1, (40, 64))
    rows = [(i, (base[i % 40] + rng.normal(0, s, 64)).astype(np.float32).tolist(), int(i % 3)) for i, s in enumerate(rng.choice([0.0, 0.05, 0.2, 0.27, 0.3], 600))]
    links = brute_vectors(rows)
    got = {r["vec_id"]: r for r in vecdedup.near_duplicate_vectors(vectors(spark, rows), vecdedup.Params(chunk=16)).collect()}
    wanted, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= len(links[i]) for i in got)
    assert found >= 0.9 * wanted > 0
    component = reach(got, links)
    assert sum(got[i]["component_id"] == component[i] for i in got) >= 0.95 * len(got)


def test_vector_dedup_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0], 1), (9, [float("inf"), 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_duplicate_vectors(vectors(spark, rows).withColumn("kept", F.lit(5)).withColumn("node", F.lit(1))).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[2] == (2, 0, False)
    assert all(got[i] == (0, i, True) for i in range(3, 10))
    assert vecdedup.near_duplicate_vectors(vectors(spark, []).limit(0)).collect() == []
    odd = vectors(spark, [(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (9, [1.0, 0.01], 1)])
    got = sorted(map(tuple, vecdedup.near_duplicate_vectors(odd).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 1, 3, True), (3, 1, 2, False), (2, 1, 2, True), (9, 1, 3, False)], key=str)


def test_pivots_grow_and_recall_stays():
    p = vecdedup.Params()
    rng = np.random.RandomState(0)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for n in (1000, 1 << 22, 1 << 28):
        pivots = rng.normal(size=(p.pivots(n), 64))
        pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
        a, b = (vecdedup.prefixes(m, pivots, p.length(len(pivots))) for m in (x, y))
        assert ((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= p.shared).mean() >= 0.95
    assert [p.pivots(n) for n in (0, 1 << 18, 1 << 20)] == [64, 64, 128]


# --- op3, op7 -------------------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    found = queries.op3_quality(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    r = found.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) >= 0.9
    assert all(0 <= x["score"] <= 1 for x in r)
    assert found.count() == spark.read.parquet(f"{big}/documents.parquet").count()


def test_quality_edge_cases(spark):
    d = docs(spark, ["", None, "ok text here", LONG, "ok text here"]).withColumn("x", F.lit(1))
    s = quality.document_statistics(d)
    assert s.count() == 5 and len({len(r["x"]) for r in s.collect()}) == 1
    assert [r["score"] for r in quality.score(s, quality.fit(s.limit(0).withColumn("y", F.lit(1.0)))).collect()] == [0.5] * 5
    one = quality.fit(s.withColumn("y", F.lit(1.0)))
    assert all(r["score"] > 0.9 for r in quality.score(s, one).collect())
    assert quality.document_statistics(d.limit(0)).count() == 0
    assert quality.one_label(spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")).collect() == [(1, 0.0)]


def test_pooling():
    assert quality.pool(np.arange(5), np.array([0, 1, 0, 1, 1.0]), np.ones(5)).tolist() == [0, 0.5, 0.5, 1, 1]


def test_language_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    found = queries.op7_language_id(spark, big)
    r = found.where("held_out").join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in r) / len(r) >= 0.95
    assert all(0 <= x["score"] <= 1 for x in r)


def brute_code_length(train: bytes, text: bytes, order: int) -> float:
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    data = bytes(order) + train
    for i in range(order, len(data)):
        for k in range(order + 1):
            counts[k][data[i - k : i]][data[i]] += 1
    total, data = 0.0, bytes(order) + text
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if seen[data[i]]:
                total -= np.log2(seen[data[i]] / (n + d))
                break
            total -= np.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    train = {"a": "the cat sat on the mat and the rat", "b": "le chat est sur le tapis été"}
    m = langid.Model({k: pa.array([v]) for k, v in train.items()}, 4)
    texts = ["the chat", "zzz the", "été", "", "sat on le tapis"]
    got = m.lengths(*textops.buffers(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx([brute_code_length(train[k].encode(), t.encode(), 4) for k in "ab"], rel=1e-5)


def test_language_edge_cases(spark):
    train = docs(spark, ["the cat and the dog"] * 3).unionByName(docs(spark, ["le chat et le chien"] * 3, [10, 11, 12], "fr"))
    m = langid.fit(train.unionByName(docs(spark, [None, "x"], [20, None], None)))
    d = docs(spark, ["the dog", None, "", "123 !", LONG, "le chien"]).withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("zz"))
    r = langid.predict(d, m).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in r] == ["en", "und", "und", "und", "en", "fr"]
    assert all(x["score"] == 0 for x in r if x["lang_pred"] == "und")
    kept = langid.reject_unknown(d, m)
    assert kept.columns == d.columns and sorted(x["doc_id"] for x in kept.collect()) == [0, 4, 5]
    none = langid.fit(train.limit(0))
    assert {x["lang_pred"] for x in langid.predict(d, none).collect()} == {"und"}


def test_a_language_of_long_texts_is_learned_and_columns_stay(spark):
    long_ = "il gatto dorme sulla tavola e non vuole scendere " * 900
    train = docs(spark, ["the cat and the dog sleep on the table"] * 3).unionByName(docs(spark, [long_, long_], [10, 10], "it"))
    m = langid.fit(train)
    d = docs(spark, ["il gatto vuole dormire", "the dog sleeps"]).withColumn("lang_pred", F.lit("zz")).withColumn("bits_per_byte", F.lit(7.0)).withColumn("__whole", F.lit(1))
    assert m.languages == ["en", "it"] and [r["lang_pred"] for r in langid.predict(d, m).orderBy("doc_id").collect()] == ["it", "en"]
    kept = langid.reject_unknown(d, m)
    assert kept.columns == d.columns and all(r["lang_pred"] == "zz" and r["bits_per_byte"] == 7.0 and r["__whole"] == 1 for r in kept.collect()) and kept.count() == 2


def test_unknown_languages_are_rejected(spark, sf):
    known = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    model = langid.fit(known.where(~langid.held_out()))
    foreign = ["Il gatto dorme sul tavolo della cucina e non vuole scendere per mangiare la cena", "A macska az asztalon alszik és nem akar lejönni vacsorázni a konyhában", "Kissa nukkuu keittiön pöydällä eikä halua tulla alas syömään illallista"]
    own = [r["text"] for r in known.where("lang = 'en' and length(text) between 400 and 2000").orderBy("doc_id").limit(3).collect()]
    other = next(r["text"] for r in known.where("lang = 'fr' and length(text) between 400 and 2000").orderBy("doc_id").limit(1).collect())
    keep = [own[0], own[1][:40] + ' token = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab"', own[2][:300] + " " + other[:300]]
    parts = [own[0][:200] + " " + (f * 6)[:400] for f in foreign]
    got = {r["doc_id"]: r["text"] for r in langid.reject_unknown(docs(spark, keep + foreign + parts), model).collect()}
    assert got == dict(enumerate(keep))
    held = known.where(langid.held_out() & F.col("text").rlike(r"\p{L}"))
    assert langid.reject_unknown(held, model).count() >= 0.99 * held.count()


# --- op4 ------------------------------------------------------------------------------------------------------------


def brute_documents(texts, n=4):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
    return sets, reach(sets, links)


def test_minhash_matches_brute_force(spark):
    rng = np.random.RandomState(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, rng.randint(5, 300)).tolist()
        for edits in (0, 0, 1, 2, 4, 8):
            own = list(base)
            for k in rng.randint(0, len(own), min(edits, len(own) // 8)):
                own[k] = rng.choice(words)
            texts.append(" ".join(own))
    texts += ["", None, "a", "A", "a b", "a b c d", LONG, LONG + "x"]
    rows = list(enumerate(texts))
    sets, component = brute_documents(rows)
    for p in (minhash.Params(), minhash.Params(chunk=4, unit=2, crowd=2)):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts).withColumn("digest", F.lit(1)), p).collect()}
        assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
        assert {i: r["component_id"] for i, r in got.items()} == component
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_minhash_of_large_families_loses_no_link(spark):
    rng = np.random.RandomState(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(3):  # chains: each text is a few words off the one before, so ends of a family aren't alike
        now = rng.choice(words, 150).tolist()
        for _ in range(120):
            now = list(now)
            for i in rng.randint(0, len(now), 1 + k):
                now[i] = rng.choice(words)
            texts.append(" ".join(now))
    rows = list(enumerate(rng.permutation(texts).tolist()))
    _, component = brute_documents(rows)
    assert 1 < len(set(component.values())) < 200
    for p in (minhash.Params(unit=16, crowd=8), minhash.Params()):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, [t for _, t in rows]), p).collect()}
        assert got == component


def test_minhash_edge_cases(spark):
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).collect() == []
    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    d = docs(spark, [a, a, b, a, "x y", "", a, b], [5, 5, 5, 4, None, 6, None, 3])
    r = minhash.near_duplicates(d.withColumn("group", F.lit(1)).withColumn("kept", F.lit(1))).collect()
    found = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in r), key=str)
    assert found == sorted([(5, 4, False), (5, 4, False), (5, 3, False), (4, 4, True), (None, None, True), (6, 6, True), (None, None, True), (3, 3, True)], key=str)
    e = docs(spark, [a, a, a + " k", b, "", "", None, a], [5, 5, 5, 7, 8, 8, 9, None]).withColumn("group", F.lit("g")).withColumn("text_key", F.lit(3))
    left = minhash.without_copies(e)
    assert left.columns == e.columns
    rows = sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=str)
    assert [x for x in rows if x[0] != 5] == sorted([(7, b), (8, ""), (8, ""), (9, None), (None, a)], key=str) and len(rows) == 6


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(0)
    pool = rng.randint(0, 2**62, 3000).astype(np.uint64)
    for overlap in (0.5, 0.8, 0.95):
        n, k = 800, int(800 * 2 * overlap / (1 + overlap))
        a, b = pool[:n], np.concatenate([pool[:k], pool[n : 2 * n - k]])
        same = (minhash.signature(a, 500) == minhash.signature(b, 500)).mean()
        assert abs(same - overlap) < 0.07
    assert np.isfinite(minhash.signature(pool[:1], 64)).all()


# --- op5 ------------------------------------------------------------------------------------------------------------


def test_cross_entropy_difference(spark):
    texts = ["green apple pie"] * 30 + ["red stone wall"] * 30 + ["green apple", "stone wall", "", None]
    d = docs(spark, texts).withColumn("target", F.lit(3))
    good = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (0,)], "doc_id long")
    r = {x["doc_id"]: x for x in lmscore.cross_entropy_difference(d, good).collect()}
    assert len(r) == len(texts) and r[60]["score"] < 0 < r[61]["score"]
    assert r[62]["score"] is None and r[63]["n_tokens"] == 0
    assert lmscore.cross_entropy_difference(d.limit(0), good).collect() == []


def test_scores_equal_exact_counts_beyond_any_number_of_slots(spark):
    rng = np.random.RandomState(5)
    texts = [" ".join(f"w{k}" for k in rng.randint(0, 3000, 40)) for _ in range(300)] + ["w1", "", None, "w1 w1 w2 never"]
    good = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")
    p = lmscore.Params(tokens=1500, bucket=1 << 12)
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(docs(spark, texts).repartition(3), good, p).collect()}
    single, pair, tokens = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, t in enumerate(texts):
        w = (t or "").split()
        for m in (0, 1) if i < 300 and i % 3 == 0 else (0,):
            single[m].update(w)
            pair[m].update(zip([None, *w], w, strict=False))
            single[m][None] += bool(w)
            tokens[m]["n"] += len(w)
    v = len(single[0]) - 1
    for i, t in enumerate(texts):
        w = (t or "").split()
        assert got[i]["n_tokens"] == len(w)
        if w:
            p_w = lambda m, x: (single[m][x] + p.alpha) / (tokens[m]["n"] + p.alpha * v)
            loss = [np.mean([-np.log2((pair[m][h, x] + p.mu * p_w(m, x)) / (single[m][h] + p.mu)) for h, x in zip([None, *w], w, strict=False)]) for m in (0, 1)]
            assert [got[i]["background_loss"], got[i]["target_loss"], got[i]["score"]] == pytest.approx([*loss, loss[1] - loss[0]], rel=1e-9)
        else:
            assert got[i]["score"] is None


# --- op6 ------------------------------------------------------------------------------------------------------------


def test_url_rules_and_parsing(spark):
    rows = [
        ("https://a.NET/x", "a.net", "/x", "net/", "block"), ("https://net", "net", "", None, None), ("http://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("x://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"), ("x://badexample.com/de/1", "badexample.com", "/de/1", None, None), ("http://o.org/fr/", "o.org", "/fr/", "org/fr/", "allow"), (None, "", "", None, None), ("nothing", "", "", None, None),
        ("http://h?x://y/z", "h", "", None, None), ("a://b.net/p\nq", "b.net", "/p\nq", "net/", "block"), ("", "", "", None, None),
    ]
    d = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, host string")
    model = urls.fit(urls.example_labels(spark, 400))
    for m in (model, None):
        got = {r["page_id"]: r for r in urls.filter_urls(d, m).collect()}
        for i, (_, host, path, rule, verdict) in enumerate(rows):
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
            assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.fit(urls.example_labels(spark, 400).limit(0)) is None
    assert urls.filter_urls(d.limit(0), model).collect() == []


def test_url_trees_on_held_out_examples(spark):
    labelled = urls.example_labels(spark, 6000).withColumn("page_id", F.abs(F.xxhash64("url")))
    model = urls.fit(labelled.where("page_id % 3 <> 0"))
    r = urls.filter_urls(labelled.where("page_id % 3 = 0"), model, ()).collect()
    assert sum((x["verdict"] == "block") == bool(x["label"]) for x in r) / len(r) >= 0.8
    bare = [x for x in r if not re.search(r"-|\d{5}|&|\.(info|biz|top|click)/|//[^/]*\d", x["url"])]
    assert len(bare) > 300 and sum(x["verdict"] == "block" for x in bare if not x["label"]) <= 0.01 * len(bare)
    assert max(model.suffix.values()) > 2 * min(model.suffix.values())


def test_url_labels_by_words_and_trees_on_pages(spark, sf):
    got = urls.word_labels(spark.createDataFrame([("http://www.casino-win.example.com/x",), ("http://thecasinos.org",), ("http://a.b/casino",), (None,), ("none",)], "url string")).collect()
    assert [(r["url"], r["label"]) for r in got] == [("http://www.casino-win.example.com/x", 1), ("http://thecasinos.org", 0), ("http://a.b/casino", 0)]
    pages = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/pages.parquet").select("page_id", "url")
    known = urls.word_labels(pages.where("page_id % 5 <> 0"))
    model = urls.fit(known.unionByName(urls.example_labels(spark)))
    r = urls.filter_urls(urls.word_labels(pages.where("page_id % 5 = 0")), model, ()).collect()
    assert r and sum((x["verdict"] == "block") == bool(x["label"]) for x in r) / len(r) >= 0.95


# --- op8 ------------------------------------------------------------------------------------------------------------

ODD = ["", None, "It's the dog's bone; we'll they've I'm 'street 're've can't ''s d'été", "ÉTÉ × 3.14", "a<|endoftext|>b", "日本語", "İ ŉ café", "l'l'll 's' ''", "x" * 9000, LONG[:40_000], "\x00\x7f ctl"]


def test_ids_equal_the_library():
    enc = tokens.encoder(packing.vocabulary())
    ids, at = enc.encode(pa.array(ODD, pa.string()))
    for i, t in enumerate(ODD):
        assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_is_gapless_and_complete(spark):
    d = docs(spark, [*ODD, *("some words here " * k for k in range(1, 400, 7)), "same", "same"], [*range(len(ODD) + 57), 900, 900]).withColumn("offset", F.lit(1))
    path = packing.vocabulary()
    placed = packing.pack_documents(d, path, packing.Params(cell=16))
    rows = placed.collect()
    enc = tokens.encoder(path)
    want = collections.Counter()
    for r in d.collect():
        ids = [*enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[(r["doc_id"], k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(d, placed, path).collect()}
    assert {k: len(v) // 4 for k, v in made.items()} == {k: sum(n for _, n in v) for k, v in by.items()}
    assert packing.pack_documents(d.limit(0), path).collect() == []


def naive_best_fit(lengths, p):
    full = (p.tokens, p.pieces, p.cost)
    bins = []
    place = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        own = (lengths[i], 1, (-(-lengths[i] // p.tile)) ** 2)
        fits = [(sum(w * ((r - o) / f) ** 2 for w, r, o, f in zip(p.weights, room, own, full, strict=True)), b) for b, room in enumerate(bins) if all(r >= o for r, o in zip(room, own, strict=True))]
        b = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(full)
        bins[b] = tuple(r - o for r, o in zip(bins[b], own, strict=True))
        place[i] = b
    return place


def test_best_fit_equals_a_plain_one_and_every_capacity_binds():
    rng = np.random.RandomState(4)
    for kind in (rng.randint(1, 2049, 300), rng.randint(1, 9, 900), np.concatenate([np.full(9, 2040), rng.randint(1, 4, 60)]), np.repeat([5], 40)):
        lengths = rng.permutation(kind).astype(np.int64)
        p = packing.Params()
        bins, _ = packing.best_fit(lengths, p)
        # Norms are compared in floating point, so equal ones may be told apart either way: what a bin holds is compared.
        naive = naive_best_fit(lengths.tolist(), p)
        held = lambda place: sorted(sorted(lengths[np.array(place) == b].tolist()) for b in set(place))
        assert held(bins.tolist()) == held(naive)
        for b in set(bins.tolist()):
            own = lengths[bins == b]
            assert own.sum() <= p.tokens and len(own) <= p.pieces and p.tiles(own).sum() <= p.cost
    many = np.ones(1000, np.int64)
    assert len(set(packing.best_fit(many)[0].tolist())) == 4  # pieces
    tight = np.concatenate([np.full(3, 2000), np.ones(20)]).astype(np.int64)
    assert len(set(packing.best_fit(tight)[0].tolist())) == 4  # cost: tokens would do with three
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit(np.array([11]), packing.Params(tokens=10))


def test_capacities_give_way_to_small_pieces(spark):
    p = packing.Params()
    used = lambda found: int(found[0].max()) + 1
    for lengths in (np.full(4096, 2), np.full(4096, 3), np.full(4096, 1), np.append(np.full(3096, 2), np.full(1000, 2048)), np.full(300, 1100)):
        tokens_alone = used(packing.best_fit(lengths, packing.Params(pieces=2048, cost=2048)))
        found = packing.fitted(lengths, p)
        assert used(found) <= 1.01 * tokens_alone
        room = np.bincount(found[0], lengths)
        assert room.max() <= 2048 and room.sum() == lengths.sum()
    mixed = np.random.RandomState(2).randint(1, 900, 4096)
    assert (packing.fitted(mixed, p)[0] == packing.best_fit(mixed, p)[0]).all()
    found = packing.pack_documents(docs(spark, ["word"] * 8192), packing.vocabulary())
    assert found.select("sequence_id").distinct().count() <= 9


def test_packing_is_near_the_least_number_and_ignores_hot_ids(spark):
    rng = np.random.RandomState(6)
    d = docs(spark, ["word " * int(n) for n in rng.randint(1, 900, 400)], [None] * 200 + [7] * 200)
    placed = packing.pack_documents(d, packing.vocabulary(), packing.Params(cell=64)).collect()
    used = len({r["sequence_id"] for r in placed})
    least = -(-sum(r["length"] for r in placed) // 2048)
    cells = collections.Counter(r["sequence_id"] >> 24 for r in placed)
    assert least <= used <= least + len(cells) and len(cells) > 1 and max(cells.values()) <= 150


# --- op9 ------------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda v: re.sub("[^0-9]", "", v)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m[0])]


PERSONAL = [
    "mail a.b@c.de and x@y.z_d@e.f or @no me@host", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.255", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111", "call +49 (30) 1234-5678. or +1 2 or +12345678901234567",
    "😀 é a@b.c 😀 1.2.3.4 +1 555 123 4567", "", None, "a" * 60_000, "1" * 60_000, "1 " * 30_000 + "@", "+1" * 2000, "a@b.c," * 500, "x@y.z@w.v", "+4111 1111 1111 1111",
]


def test_personal_data_matches_the_patterns(spark):
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs(spark, PERSONAL).withColumn("spans", F.lit(1)))).collect()}
    for i, t in enumerate(PERSONAL):
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i]["spans"] == ",".join(want)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s.startswith(k) for s in want) for k in pii.BASE]
    assert pii.digest(pii.find(docs(spark, ["a"]).limit(0))).collect() == []


def test_disclosing_terms_are_found_and_replaced(spark):
    rng = np.random.RandomState(1)
    fill = lambda: " ".join(f"w{k}" for k in rng.randint(0, 500, 12))
    texts = [f"{fill()} Zorblax wrote boss@corp.example about {fill()}" for _ in range(12)] + [f"{fill()} about it {fill()}" for _ in range(60)] + ["Only Zorblax here"]
    found = pii.find(docs(spark, texts), pii.Params(confidence=0.8, bits=2.0))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(found).collect()}
    assert "[EMAIL]" in clean[0] and "[TERM]" in clean[0] and "corp" not in clean[0] and "Zorblax" not in clean[0]
    assert clean[72] == "Only [TERM] here" and clean[20] == texts[20]
    assert {"term"} == {s.split(":")[0] for s in next(r["spans"] for r in pii.digest(found).collect() if r["doc_id"] == 72).split(",")}


def test_disclosing_terms_far_from_the_entity_and_short_ones(spark):
    rng = np.random.RandomState(2)
    fill = lambda n: " ".join(f"w{k}" for k in rng.randint(0, 500, n))
    texts = [f"{fill(15)} write to boss@corp.example now {fill(40)} signed Quandle and {fill(5)} Li" for _ in range(12)] + [f"{fill(60)} ." for _ in range(60)] + ["Quandle and Li here"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs(spark, texts), pii.Params(confidence=0.8, bits=2.0))).collect()}
    assert clean[72] == "[TERM] and [TERM] here" or clean[72] == "[TERM] [TERM] [TERM] here"
    assert all("Quandle" not in clean[i] and " Li" not in clean[i] for i in range(12)) and clean[20] == texts[20]


def test_witnesses_are_groups_of_near_copies(spark):
    rng = np.random.RandomState(3)
    fill = lambda n: " ".join(f"w{k}" for k in rng.randint(0, 900, n))
    header = "from the desk of the office in the old town hall contact Falcon desk at falco@y.example now"
    letters = [f"{header} {fill(60)}" for _ in range(12)]
    base = fill(80).split()
    copies = [" ".join([*base[:60], "ask Morlock about me@copy.example", *base[60:79], f"v{i}"]) for i in range(12)]
    texts = letters + copies + [fill(60) for _ in range(160)] + ["only Falcon here", "only Morlock here"]
    p = pii.Params(confidence=0.8, bits=2.0)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs(spark, texts), p)).collect()}
    assert "Falcon" not in clean[184] and clean[185] == "only Morlock here"
    more = {r["doc_id"]: r["text"] for r in pii.sanitise(pii.find(docs(spark, texts + [f"{letters[0]} x{i}" for i in range(20)]), p)).collect()}
    assert "Falcon" not in more[184]


def brute_terms(texts, p):
    """Disclosing (term, entity) by plain counting; texts without near copies are witnesses each."""
    distinct = sorted({t for t in texts if t is not None})
    words = lambda t: set(re.findall(r"[^\W\d_][\w'-]*", t.lower()))
    of_entity, rest, n_t = collections.defaultdict(set), {}, collections.Counter()
    for k, t in enumerate(distinct):
        spans = [(int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in base_spans(t)]
        for a, b, kind in spans:
            of_entity[f"{kind}:{t[a:b].lower()}"].add(k)
        masked = t
        for a, b, _ in sorted(spans, reverse=True):
            masked = masked[:a] + " " + masked[b:]
        rest[k] = words(masked)
        n_t.update(words(t))
    found = set()
    for e, of in of_entity.items():
        for term, n in collections.Counter(w for k in of for w in rest[k]).items():
            confidence = n / n_t[term]
            if len(of) >= p.witnesses and n >= p.witnesses and confidence >= p.confidence and np.log2(confidence / (len(of) / len(distinct))) >= p.bits:
                found.add((term, e))
    return found


def test_disclosing_terms_equal_plain_counts_with_the_registered_thresholds(spark):
    rng = np.random.RandomState(11)
    fill = lambda n: " ".join(f"w{k}" for k in rng.randint(0, 3000, n))
    texts = [f"{fill(25)} Zorblax {fill(9)} boss@corp.example {fill(20)}" for _ in range(12)]
    texts += [f"{fill(25)} Quandle {fill(9)} 10.1.2.3 {fill(20)} common" for _ in range(4)]  # too few witnesses
    texts += [f"{fill(25)} common {fill(9)} me@far.example {fill(20)}" for _ in range(9)]
    texts += [f"{fill(50)} common" for _ in range(40)] + [fill(50) for _ in range(200)] + ["only Zorblax here", None, ""]
    d = docs(spark, texts).withColumn("key", F.lit("k")).withColumn("term", F.lit(1)).withColumn("rest", F.lit(2))
    p = pii.Params()
    found = pii.find_base(d).where(F.size(F.concat(*(F.col(f"pii_{k}") for k in pii.BASE))) > 0)
    got = {(r["term"], r["entity"]) for r in pii.disclosing_terms(d, found, p).collect()}
    assert got == brute_terms(texts, p) == {("zorblax", "email:boss@corp.example")}
    r = pii.sanitise(pii.find(d)).orderBy("doc_id").collect()
    assert "[TERM]" in r[0]["text"] and r[-3]["text"] == "only [TERM] here" and r[-3]["key"] == "k" and r[30]["text"] == texts[30]


def test_many_findings_in_one_text(spark):
    text = "a@b.cd 10.0.0.1 " * 6000
    r = pii.find(docs(spark, [text])).select("pii_email", F.size("pii_ip").alias("n"), "text").collect()[0]
    assert len(r["pii_email"]) == r["n"] == 6000 and [(x["start"], x["end"]) for x in r["pii_email"][511:514]] == [(16 * k, 16 * k + 6) for k in (511, 512, 513)]
    assert pii.sanitise(pii.find(docs(spark, [text]))).collect()[0]["text"] == "[EMAIL] [IP] " * 6000


def test_sanitise_overlaps(spark):
    r = pii.sanitise(pii.find(docs(spark, ["é +4111 1111 1111 1111 a@b.c1.2.3.4 end", None, "plain"]))).orderBy("doc_id").collect()
    assert r[0]["text"].startswith("é +[CARD] [EMAIL]") and r[0]["text"].endswith(" end") and "1111" not in r[0]["text"] and "@" not in r[0]["text"]
    assert r[1]["text"] is None and r[2]["text"] == "plain"


# --- op10 -----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_meets_its_targets(spark):
    rng = np.random.RandomState(2)
    rows = [(i, " ".join(["w"] * int(n)), "en", s, 0) for i, (n, s) in enumerate(zip(rng.lognormal(4, 1, 900), rng.choice(["b", "a", "é", "Z", None], 900, p=[0.1, 0.5, 0.1, 0.2, 0.1]).tolist(), strict=True))]
    d = spark.createDataFrame(rows, DOC).withColumn("size", F.lit(3)).withColumn("moves", F.lit(1))
    got = mixing.mixed_sizes(d).collect()
    assert got and sorted(map(tuple, mixing.mixed_sizes(d.repartition(5)).collect())) == sorted(map(tuple, got))
    source = {r[0]: r[3] for r in rows}
    sizes = collections.Counter()
    taken = collections.Counter()
    for r in got:
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["size"] == len((rows[r["doc_id"]][1]).split())
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], rel=1e-9) and r["source_size"] == sizes[source[r["doc_id"]]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s]


def test_multipliers_solve_the_dual(spark):
    rng = np.random.RandomState(7)
    size = np.concatenate([rng.lognormal(5, 1.5, 3000).astype(int), [9_000, 9_001, 250_000]])
    sizes = spark.createDataFrame([(i, "a" if i % 4 else "b", int(n)) for i, n in enumerate(size)], "doc_id long, source string, size long")
    p = mixing.Params()
    found, few = mixing.solve(sizes, p)
    for r in found.collect():
        own = size[[i for i in range(len(size)) if ("a" if i % 4 else "b") == r["source"]]]
        z = np.maximum(0.1, own / r["mean"])
        rate = np.full(len(own), 2.0) if r["multiplier"] == float("inf") else 2 / (1 + np.exp(-r["multiplier"] * z))
        assert (own * rate).sum() == pytest.approx(r["target"], rel=1e-5)
        taken = mixing._per_source(sizes.where(F.col("source") == r["source"]), found, few).select(F.sum(F.col("size") * mixing.copies(p))).first()[0]
        assert abs(taken - r["target"]) <= np.median(own)
    with pytest.raises(Exception, match="isn't solved"):
        mixing.solve(sizes, mixing.Params(steps=1))


def test_mixing_edge_cases(spark):
    d = docs(spark, ["", None, "one two", "one two"], [1, 2, 3, 3])
    r = mixing.mixed_sizes(d).collect()
    assert len(r) == 4 and all(x["taken"] <= 2 * x["size"] for x in r)
    assert mixing.mixed_sizes(d.limit(0)).collect() == []
    assert mixing.mixed_sizes(docs(spark, ["", None])).select("taken").distinct().collect() == [(0,)]
