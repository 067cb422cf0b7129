"""Retrieval."""

SQL = {
    "chunk_documents": "SELECT * FROM chunks",
    "hash_embed": """
        SELECT doc_id, idx AS slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
          SELECT doc_id, idx, sum(sign) AS w FROM (
            SELECT doc_id, ('0x' || substr(h, 1, 2))::INT AS idx, 1 - 2 * (('0x' || substr(h, 9, 2))::INT % 2) AS sign
            FROM (SELECT doc_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS h FROM documents))
          GROUP BY doc_id, idx HAVING sum(sign) <> 0)""",
    "cosine_topk": """
        SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT c.label AS query_id, e.vec_id,
                   round(list_cosine_similarity(c.centre, CAST(e.embedding AS DOUBLE[])), 9) AS score
            FROM embeddings e, (
              SELECT label, list(x ORDER BY i) AS centre FROM (
                SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
                FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
              GROUP BY label) c))
        WHERE rank <= 5""",
    "runbook_search": "SELECT query_id, chunk_id, runbook_path, title, round(score, 6) AS score, rank FROM hits",
    "reviews_enriched": """
        SELECT review_id, rating, p AS positive_hits, n AS negative_hits,
               CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS sentiment,
               CASE WHEN list_has_any(t, ['in', 'en']) THEN 'shipping' WHEN list_has_any(t, ['to', 'des']) THEN 'quality'
                    WHEN list_has_any(t, ['was', 'la']) THEN 'price' ELSE 'other' END AS topic
        FROM (SELECT *, CAST(len(list_filter(t, lambda w: w IN ('the', 'and', 'der', 'los'))) AS INTEGER) AS p,
                     CAST(len(list_filter(t, lambda w: w IN ('le', 'of', 'und', 'que'))) AS INTEGER) AS n
              FROM (SELECT *, regexp_extract_all(lower(review_text), '[a-z0-9_]+') AS t FROM reviews_silver))""",
}
