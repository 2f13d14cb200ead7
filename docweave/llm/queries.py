"""The subpackage's registered queries: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, langid, lmscore, minhash, mixing, packing, phrases, pii, quality, topk, urls, vecdedup
from .scratch import materialise, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    known = found.where(~langid.held_out()).join(quality.one_label(table(spark, sf_dir, "labels")), "doc_id")
    scored = quality.score(found, quality.fit(known))
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = urls.word_labels(pages.where(~langid.held_out("url"))).unionByName(urls.example_labels(spark))
    found = urls.filter_urls(pages, urls.fit(labelled))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.vocabulary())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.digest(bpe.decode(ids, path))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_embedding_dedup, op3_quality, op4_minhash_dedup, op5_lm_score, op6_url_filter, op7_language_id, op8_packing, op9_pii, op10_mixing, op11_clustering, op12_collocations, op13_byte_bpe)}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _lloyd(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of Lloyd's rounds over x (id, i, x), from the centroids c0 (c, v)."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""
        y{k} AS (SELECT c, unnest(v) AS y, unnest(range(64)) AS i FROM c{k}),
        d{k} AS (SELECT id, c, sum((x - y) * (x - y)) AS d FROM x JOIN y{k} USING (i) GROUP BY id, c),
        a{k} AS (SELECT id, min(c) AS c, any_value(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY id) AS least FROM d{k}) WHERE d = least GROUP BY id)""")
        if k < rounds:
            out.append(f"""
        t{k} AS (SELECT c, i, sum(x) AS t, count(*) AS n FROM a{k} JOIN x USING (id) GROUP BY c, i),
        m{k} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM t{k} GROUP BY c),
        c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c)""")
    return ",".join(out)


ORACLES = {
    "op1_topk_search": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT m.vec_id, coalesce(n.n, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
    """,
    "op4_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
    """,
    "op11_clustering": f"""
        WITH v AS (
            SELECT row_number() OVER () AS id, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS (SELECT id, unnest(v) AS x, unnest(range(64)) AS i FROM v),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
        {_lloyd(3)},
        s AS (SELECT vec_id, a3.c AS c, d, sum(d) OVER (PARTITION BY a3.c) AS cd, sum(d) OVER () AS td FROM a3 JOIN v USING (id))
        SELECT vec_id, CAST(s.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(cd AS BIGINT) AS cluster_inertia, CAST(td AS BIGINT) AS inertia,
            sha256(array_to_string(c3.v, ',')) AS centroid_sha256
        FROM s JOIN c3 ON c3.c = s.c
    """,
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^.,;:!?\\x0A-\\x0D]+')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM i, range(1, 5) AS t(k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        u AS (SELECT *, unnest(range(1, k)) AS j FROM c),
        s AS (
            SELECT u.lang, u.phrase, a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score, j
            FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1 : j], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[j + 1 : u.k], ' ')
        ),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS q FROM s),
        o AS (SELECT c.lang, c.a, array_to_string(c.w[m.i : m.i + m.k - 1], ' ') AS phrase FROM c, (SELECT x.i, y.k FROM range(1, 4) AS x(i), range(2, 4) AS y(k)) AS m WHERE m.k < c.k AND m.i + m.k - 1 <= c.k),
        h AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
        r AS (
            SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
            FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE q = 1 AND NOT coalesce(100 * longer >= 80 * a, false)
        )
        SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
    """,
}
