"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import centroids, decontamination, infill, language, neardup, packing, private, quality, scoring, secrets, tokencount, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_ngram_jaccard_join": neardup.op2_ngram_jaccard_join,
        "op3_lm_scoring": scoring.op3_lm_scoring,
        "op4_private_data": private.op4_private_data,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_exact_topk": topk.op6_exact_topk,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language": language.op9_language,
        "op10_quality": quality.op10_quality,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_centroid_clustering": centroids.op12_centroid_clustering,
        "op13_token_counts": tokencount.op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": NEAR_SQL, "op6_exact_topk": TOPK_SQL, "op11_fill_in_middle": MIDDLE_SQL, "op12_centroid_clustering": CLUSTER_SQL}


NEAR_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM worded),
copies AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS copy_id FROM sets),
parts AS (SELECT doc_id, n, unnest(s) AS g FROM copies),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common WHERE c >= 0.8 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id, d.copy_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links FROM copies d"""

TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 5"""


MIDDLE_SQL = r"""
WITH lines AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM lines),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2 FROM drawn),
parts AS (SELECT doc_id, n, text, array_to_string(l[:c1], '') AS p, array_to_string(l[c1 + 1:c2], '') AS m, array_to_string(l[c2 + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""


def cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """A round assigns, by the least (distance, number), and takes floors of means; sums and counts are whole numbers."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT n - 1 AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) AS n FROM v) WHERE n <= {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(p) AS v, min(struct_pack(d := d, c := c)) AS b FROM (SELECT r, vec_id, v.v AS p, c, {distance} AS d FROM v CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY c, k)")
            steps.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY k) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"SELECT vec_id, b.c::INTEGER AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = b.c"
    return "WITH " + ",\n".join(steps) + "\n" + last


CLUSTER_SQL = cluster_sql()
