"""Operators 11 to 13 against brute force on small fixtures, and their edge cases."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import bpe, centroids, phrases
from docweave.llm.textops import buffers

VEC = "vec_id long, embedding array<double>"
TEXT = "doc_id long, text string, lang string"
LONG = "of the and " * 70_000

# --- clustering -----------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dimensions, scale=64):
    """Rows (vec_id, vector) as (vec_id, cluster, distance) with Python's integers, and the final centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, own, strict=True)) for own in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[0]].append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else old for j, old in enumerate(c)]
    return [(i, *near(v)) for i, v in kept], c


def check_clusters(spark, rows, p):
    found = centroids.cluster(spark.createDataFrame(rows, VEC), p).collect()
    want, c = brute_clusters(rows, p.clusters, p.rounds, p.dimensions, p.scale)
    fits = lambda x: x if x < 2**63 else None
    assert sorted(map(repr, [(r["vec_id"], r["cluster"], r["distance"]) for r in found])) == sorted(repr((i, k, fits(d))) for i, k, d in want)
    by = collections.Counter()
    for _, k, d in want:
        by[k] += d
    for r in found:
        assert r["cluster_inertia"] == fits(by[r["cluster"]]) and r["inertia"] == fits(sum(by.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_clusters_match_brute_force_with_heavy_repeats_and_ties(spark):
    rng = np.random.RandomState(4)
    base = rng.randint(-3, 4, (60, 4)) / 64
    rows = [(int(i), base[rng.randint(60)].tolist()) for i in range(500)] + [(1000 + i, [0.5, 0.0, -0.0, 0.25]) for i in range(400)]
    check_clusters(spark, rows, centroids.Params(clusters=5, dimensions=4))
    check_clusters(spark, rows, centroids.Params(clusters=16, dimensions=4, rounds=2, rows=7))


def test_clusters_of_huge_and_odd_vectors(spark):
    p = centroids.Params(clusters=3, dimensions=2)
    rows = [(1, [1e30, -1e300]), (2, [3.4e38, 1.0]), (2, [3.4e38, 1.0]), (None, [2.0**40, 0.015]), (None, [0.0, 0.0]), (5, [-1e-9, 1e-9]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, [None, 1.0]), (9, None), (10, [1.0]), (11, []), (12, [1.0, 2.0, 3.0])]
    check_clusters(spark, rows, p)
    check_clusters(spark, rows[3:7], p)


def test_clusters_edge_cases(spark):
    p = centroids.Params(dimensions=2)
    one = spark.createDataFrame([(3, [1.0, 2.0], "x", 7)], VEC + ", cluster string, distance int")
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in centroids.cluster(one, p).collect()] == [(3, 0, 0)]
    assert centroids.cluster(one.limit(0), p).collect() == []
    assert centroids.cluster(one.select("vec_id", F.lit(None).cast("array<double>").alias("embedding")), p).collect() == []


def test_limbs_carry_any_integer():
    for x in (0, 1, -1, 2**40, -(2**40) + 1, 7 * 2**80 - 3, -(10**60)):
        assert sum(v << (centroids.LIMB * n) for n, v in centroids._limbs(x)) == x


# --- phrases --------------------------------------------------------------------------------------------------------


def brute_phrases(rows, p):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, p.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        frequent = {x: a for x, a in c.items() if len(x) > 1 and a >= p.min_count}
        found = []
        for x, a in frequent.items():
            if any(len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1)) and 100 * b >= p.contained * a for y, b in frequent.items()):
                continue
            score, _, left, right = min((p.scale * a // (c[x[:k]] + c[x[k:]]), k, c[x[:k]], c[x[k:]]) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), left, right))
        for rank, (s, a, x, left, right) in enumerate(sorted(found)[: p.top], 1):
            out.append((lang, rank, x.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found_phrases(spark, rows, p):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], TEXT)
    return sorted(tuple(r) for r in phrases.collocations(df, p).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "The", "AND", "é", "ÜBER", "x", "new", "york", "city", "a.b", "日本", "don't", "\x00"]
    gaps = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?", " ; ", "\x0b", "\r\n"]
    return [("".join(rng.choice(words[: rng.choice([4, 14])]) + rng.choice(gaps) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize("p", [phrases.Params(min_count=4, top=40), phrases.Params(min_count=2, top=7, chunk=300), phrases.Params(min_count=3, longest=2), phrases.Params(min_count=3, longest=5, contained=50)])
def test_phrases_match_brute_force(spark, p):
    rows = random_texts(120)
    assert found_phrases(spark, rows, p) == brute_phrases(rows, p)


def test_phrases_edge_cases(spark):
    p = phrases.Params(min_count=5)
    rows = [(None, "en"), ("", "en"), (" \t ", None), (" ,.; ", "en"), (LONG, "en"), (LONG, "en")] + [("new york", None)] * 5 + [("new york", "und")] * 2 + [("New  York city", "fr")] * 4
    assert found_phrases(spark, rows, p) == brute_phrases(rows, p)
    df = spark.createDataFrame([("a b", "en", 1, 2)], "text string, lang string, rank int, score int")
    assert phrases.collocations(df.limit(0), p).collect() == []
    assert phrases.collocations(df, phrases.Params(min_count=1)).select("phrase", "a", "score").collect() == [("a b", 1, 1_000_000)]


def test_a_crowded_sketch_only_adds_candidates():
    text = phrases.normalised(" ".join(f"w{i % 997} x{i % 13}" for i in range(4000)))
    grams = phrases.Grams(text, "en")
    full = phrases.Filter(20, {k: [np.full(1 << 17, 255, np.uint8)] * 2 for k in (1, 2, 3, 4)})
    none = phrases.Filter(20, {k: [np.zeros(1 << 17, np.uint8)] * 2 for k in (1, 2, 3, 4)})
    assert [len(at) for _, at, _ in full.candidates(grams, 4)] == [8000, 7999, 7998, 7997]
    assert [len(at) for _, at, _ in none.candidates(grams, 4)] == [0, 0, 0, 0]


def test_packed_counts():
    slots = np.sort(np.random.RandomState(1).randint(0, 1 << 20, 3000))
    slots = np.append(slots, [slots[-1]] * 70_000)
    place, count = phrases._unpack(phrases._pack(slots))
    want = np.unique(slots, return_counts=True)
    assert (place == want[0]).all() and (count == np.minimum(want[1], 0xFFFF)).all()
    assert [len(x) for x in phrases._unpack(phrases._pack(slots[:0]))] == [0, 0]


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = phrases.normalised("one two. three four five; six " * 50)
    whole = phrases.Grams(text, "en")
    monkeypatch.setattr(phrases, "_SLICE", 64)
    cut = phrases.Grams(text, "en")
    for k in (2, 3, 4):
        assert (whole.places(k) == cut.places(k)).all() and (whole.phrases(whole.places(k), k) == cut.phrases(cut.places(k), k)).all()


# --- bytes ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers
    import tiktoken

    with open(bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=4000):
    rng = random.Random(5)
    alphabets = ["'stmdrevl ab\n", "aA1 !'\t\n\r\x0b\x1c\x00", "éÉß÷×ŉ ab's", "a b  日'll🎉‍́", "   \u0085x1", "<|endoftext|> a"]
    return ["".join(rng.choice(a) for _ in range(rng.randrange(40))) for a in rng.choices(alphabets, k=n)]


def test_ids_equal_merging_by_ranks(plain):
    texts = [*odd_texts(), None, "", " ", "\n", "'", "we'LL we'll 's", "a" * 3000, " " * 3000 + "x", LONG[:40_000], "Straße 12 345 don't"]
    enc = bpe.codec(bpe.vocabulary())
    ids, at = enc.encode(pa.array(texts))
    data, byte, whole = enc.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode_ordinary(t or ""), repr(t)
        assert bytes(data[byte[i] : byte[i + 1]]) == (t or "").encode()
    assert whole.all()


def test_every_code_point_keeps_its_ids(plain):
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c}{c} {c}  {c}" for c in points]
    ids, at = bpe.codec(bpe.vocabulary()).encode(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [plain.encode_ordinary(t) for t in texts]


def test_offsets_equal_the_library(spark):
    texts = ["aé日本 x🎉y", "plain text", "🎉", "", None, "tab\tand  spaces "]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, starts string")
    tokenizer = bpe.codec(bpe.vocabulary()).tokenizer
    for r in bpe.encode(df, bpe.vocabulary(), offsets=True).collect():
        want = tokenizer.encode(r["text"] or "")
        assert r["ids"] == want.ids and list(zip(r["starts"], r["ends"], strict=True)) == want.offsets


def test_split_characters(plain):
    text = "x🎉 日本語 é"
    ids = plain.encode_ordinary(text)
    pieces = bpe.token_texts(ids, bpe.vocabulary())
    assert "".join(pieces) == text and "" in pieces and len(pieces) == len(ids)
    assert bpe.token_texts(plain.encode_ordinary("🎉")[:1], bpe.vocabulary()) == ["�"]
    assert bpe.token_texts([], bpe.vocabulary()) == []


def test_decoding_of_any_ids(spark, plain):
    one = plain.encode_ordinary("ein Satz 🎉")
    rows = [(1, one), (2, []), (3, None), (4, [50_256]), (5, [-1, 5]), (6, [None, 5]), (7, one[:-1]), (8, [2**31 - 1])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("decoded", F.lit("old"))
    found = {r["doc_id"]: (r["decoded"], r["decoded_text"]) for r in bpe.decode(df, bpe.vocabulary(), as_text=True).collect()}
    assert bytes(found[1][0]).decode() == found[1][1] == "ein Satz 🎉" and found[2] == (b"", "")
    assert all(found[i] == (None, None) for i in (3, 4, 5, 6, 8))
    assert bytes(found[7][0]) == plain.decode_bytes(one[:-1]) and found[7][1].endswith("�")


def test_digests(spark, plain):
    texts = ["", None, LONG, "the same", "the same", "日本 tail"]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, n_tokens string")
    made = bpe.digest(bpe.decode(bpe.encode(df, bpe.vocabulary()).select("doc_id", "ids"), bpe.vocabulary()))
    found = {r["doc_id"]: tuple(r)[1:] for r in made.collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert found[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digest(bpe.decode(bpe.encode(df.limit(0), bpe.vocabulary()).select("doc_id", "ids"), bpe.vocabulary())).collect() == []


def test_offsets_of_sliced_arrays():
    texts = pa.array(["skip", "a é b", "日本"]).slice(1)
    enc = bpe.codec(bpe.vocabulary())
    ids, at = enc.encode(texts)
    first, last = enc.offsets(*buffers(texts), ids, at)
    assert first[0] == 0 and last[at[1] - 1] == 5 and first[at[1]] == 0 and last[-1] == 2
