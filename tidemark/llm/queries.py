"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_read(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _tokenizer())


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import write_store

    return write_store(_read(spark, sf_dir, "documents"), _tokenizer()).documents()


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_order

    return mixed_order(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_links import link_vectors

    return link_vectors(_read(spark, sf_dir, "embeddings")).rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_html_text": op5_html_text,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_store": op7_token_store,
    "op8_source_mixing": op8_source_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END AS grams FROM d),
        m AS (SELECT doc_id, grams, CASE WHEN grams IS NOT NULL THEN min(doc_id) OVER (PARTITION BY grams) END AS node FROM s),
        n AS (SELECT node, any_value(grams) AS grams, count(*) AS weight FROM m WHERE node IS NOT NULL GROUP BY node),
        g AS (SELECT node, len(grams) AS size, md5_number(unnest(grams)) AS gram FROM n),
        p AS (SELECT a.node AS x, b.node AS y FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node AND 5 * b.size >= 4 * a.size AND 5 * a.size >= 4 * b.size
              GROUP BY a.node, b.node, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))),
        r(x, y) AS (SELECT node, node FROM n UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
        c AS (SELECT x AS node, min(y) AS class_id FROM r GROUP BY x),
        l AS (SELECT p.x AS node, sum(n.weight) AS links FROM p JOIN n ON p.y = n.node GROUP BY p.x)
        SELECT m.doc_id, coalesce(c.class_id, m.doc_id) AS class_id, CAST(CASE WHEN m.node IS NULL THEN 0 ELSE coalesce(l.links, 0) + n.weight - 1 END AS BIGINT) AS n_links, m.doc_id = coalesce(c.class_id, m.doc_id) AS kept
        FROM m LEFT JOIN n ON m.node = n.node LEFT JOIN c ON m.node = c.node LEFT JOIN l ON m.node = l.node""",
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    "op8_source_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS n_tokens,
                   CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS u
            FROM documents),
        b AS (SELECT source, u >> 50 AS block, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2),
        t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY 1 HAVING sum(tokens) > 0),
        q AS (SELECT source, tokens, CAST(tokens AS DOUBLE) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM t) AS q FROM t),
        c AS (SELECT CAST(sum(tokens) AS DOUBLE) AS budget, 0.95 * ln(CAST(count(*) AS DOUBLE)) AS entropy FROM t),
        e(lo, hi) AS (
            SELECT 0, 1048577
            UNION ALL
            SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
            FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
                         (SELECT ln(sum(pow(q, ((lo + hi) // 2) / 1048576.0))) - sum(pow(q, ((lo + hi) // 2) / 1048576.0) * ln(pow(q, ((lo + hi) // 2) / 1048576.0))) / sum(pow(q, ((lo + hi) // 2) / 1048576.0)) FROM q)
                         >= (SELECT entropy FROM c) - 1e-12 AS ok FROM e) WHERE hi - lo > 1),
        r(lo, hi) AS (
            SELECT -1, 1048576
            UNION ALL
            SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
            FROM (SELECT lo, hi, (lo + hi) // 2 AS mid,
                         (SELECT max(pow(q, ((lo + hi) // 2) / 1048576.0) / tokens) / sum(pow(q, ((lo + hi) // 2) / 1048576.0)) FROM q)
                         * (SELECT budget FROM c) <= 4.0 + 1e-12 AS ok FROM r) WHERE hi - lo > 1),
        k AS (SELECT greatest((SELECT max(lo) FROM e), (SELECT min(hi) FROM r)) AS k),
        w AS (SELECT source, tokens, CAST(floor(pow(q, (SELECT k FROM k) / 1048576.0) / (SELECT sum(pow(q, (SELECT k FROM k) / 1048576.0)) FROM q) * (SELECT budget FROM c) + 1e-6) AS BIGINT) AS budget FROM q),
        s AS (SELECT source, budget // tokens AS epochs, budget % tokens AS rest FROM w),
        p AS (
            SELECT b.source, b.block, b.tokens, s.epochs,
                   s.rest - coalesce(sum(b.tokens) OVER (PARTITION BY b.source ORDER BY CAST('0x' || substr(md5('17:' || s.epochs || ':' || coalesce(b.source, '') || ':' || b.block), 1, 15) AS BIGINT), b.block
                                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
            FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source),
        x AS (
            SELECT d.doc_id, d.source, d.n_tokens, d.u, p.block, p.epochs, p.room, p.tokens,
                   sum(d.n_tokens) OVER (PARTITION BY d.source, p.block ORDER BY d.u) AS upto
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND (d.u >> 50) = p.block),
        y AS (SELECT *, epochs + CASE WHEN room >= tokens OR (room > 0 AND upto <= room) THEN 1 ELSE 0 END AS times FROM x),
        z AS (SELECT *, unnest(range(times)) AS epoch FROM y WHERE times > 0)
        SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(block AS BIGINT) AS block,
               CAST('0x' || substr(md5('17:' || epoch || ':' || coalesce(source, '') || ':' || block), 1, 15) AS BIGINT) AS block_order
        FROM z""",
    "op9_substring_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
        u AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY md5_number(win)) AS n FROM u) WHERE n > 1),
        k AS (SELECT r, k, x FROM (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d)),
        c AS (SELECT k.r, k.k, k.x, max(h.i) OVER (PARTITION BY k.r ORDER BY k.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM k LEFT JOIN h ON h.r = k.r AND h.i = k.k),
        g AS (SELECT r, count(*) AS n, count(*) FILTER (last IS NOT NULL AND k < last + 35) AS gone, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (last IS NULL OR k >= last + 35), '') AS kept FROM c GROUP BY r)
        SELECT d.doc_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_words, CAST(coalesce(g.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.r = g.r""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
        r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
        SELECT c.x AS vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, c.x = c.component_id AS kept
        FROM c LEFT JOIN n ON c.x = n.x""",
}
