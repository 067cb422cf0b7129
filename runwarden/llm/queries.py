"""The registered queries of the operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwarden.llm import (
    bpe,
    conversations,
    decontamination,
    fingerprints,
    mainpage,
    merkle,
    oddsketch,
    packing,
    repeats,
    secrets,
    toxicity,
    vectors,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprints.compared_with_next(docs, classes=fingerprints.near_duplicates(docs))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(_table(spark, sf_dir, "pages"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")
    return warc.read(archives.index, archives.files).select(*columns)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.sequences(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).drop("text")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text", "clean_text")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_mainpage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainpage.main_text(_table(spark, sf_dir, "pages"))


def op10_oddsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = oddsketch.near_duplicates(_table(spark, sf_dir, "documents"), width=2)
    return found.withColumnRenamed("id", "doc_id")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digests(found)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(_table(spark, sf_dir, "documents")))


_QUERIES = (
    op1_fingerprints,
    op2_warc,
    op3_vectors,
    op4_bpe,
    op5_toxicity,
    op6_secrets,
    op7_packing,
    op8_repeats,
    op9_mainpage,
    op10_oddsketch,
    op11_decontamination,
    op12_conversations,
    op13_merkle,
)

_SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
       coalesce(url, '') AS url, true AS intact
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest""",
    "op3_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM m LEFT JOIN n ON m.id = n.a""",
    "op8_repeats": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
d AS (SELECT h FROM h GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN d ON h.h = d.h),
k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x
  ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op10_oddsketch": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept
FROM m LEFT JOIN n ON m.id = n.doc_id""",
    "op11_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (
  SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda k: array_to_string(w[k:k + 9], ' '))) AS win FROM b WHERE len(w) > 0),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT n FROM i)),
o AS (
  SELECT DISTINCT doc_id, pos, p.n, item_id FROM (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS win FROM p) p
  JOIN i ON p.n = i.n AND p.win = i.win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM o) GROUP BY 1),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op12_conversations": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, coalesce(':' || conv_id, '-') AS g FROM conversations),
z AS (
  SELECT k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::UBIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 20 AS z
  FROM (SELECT DISTINCT k FROM c)),
d AS (
  SELECT g, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN z = 1 THEN '' WHEN z = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN z = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN z ON c.k = z.k WHERE z <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role,
    sha256(octet_length(encode(role)) || ':' || role || text), copy) AS pos FROM d),
r AS (
  SELECT g, pos, turn, role, text, role[1] AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS dup,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open,
    lag(role[1]) OVER (PARTITION BY g ORDER BY pos) AS before FROM o),
n AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate,
    count(*) FILTER (open AND NOT dup AND NOT blank) AS truncated,
    count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
v AS (
  SELECT g, n + 1 AS pos, [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM n
  UNION ALL
  SELECT g, pos, [
    list_min([w[1], {'c': v3.c + 2, 'a': 'I' || v3.a}]), list_min([w[2], {'c': v3.c + 2, 'a': 'I' || v3.a}]), v3, v4]
  FROM (
    SELECT g, pos, w, list_min([w[3], {'c': w[4].c + 2, 'a': 'I' || w[4].a}]) AS v3,
      list_min([w[4], {'c': w[3].c + 2, 'a': 'I' || w[3].a}]) AS v4
    FROM (
      SELECT r.g, r.pos, list_transform([1, 2, 3, 4], lambda s: list_min([
        {'c': v[s].c + 3, 'a': 'D' || v[s].a},
        {'c': CASE WHEN blank OR dup THEN 1000000 ELSE v[CASE WHEN s = 3 THEN 4 ELSE 3 END].c + 2 + open::INT END,
         'a': 'R' || v[CASE WHEN s = 3 THEN 4 ELSE 3 END].a},
        CASE WHEN blank OR dup THEN {'c': 1000000, 'a': 'K'}
          WHEN s = 1 AND i = 's' THEN {'c': v[2].c + open::INT, 'a': 'K' || v[2].a}
          WHEN s <> 3 AND i = 'u' THEN {'c': v[3].c + open::INT, 'a': 'K' || v[3].a}
          WHEN s = 3 AND i = 'a' THEN {'c': v[4].c + open::INT, 'a': 'K' || v[4].a}
          ELSE {'c': 1000000, 'a': 'K'} END])) AS w
      FROM v JOIN r ON v.g = r.g AND r.pos = v.pos - 1))),
best AS (SELECT g, v[1].c AS cost, v[1].a AS audit FROM v WHERE pos = 1),
f AS (
  SELECT g, audit, 1 AS p, 1::BIGINT AS pos, '' AS before, []::VARCHAR[] AS lines FROM best
  UNION ALL
  SELECT f.g, audit, p + 1, f.pos + (audit[p] <> 'I')::INT,
    CASE WHEN audit[p] = 'D' THEN f.before WHEN audit[p] = 'K' THEN r.i WHEN f.before = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN audit[p] = 'D' THEN lines
      ELSE list_append(lines, CASE WHEN audit[p] = 'K' THEN r.role WHEN f.before = 'u' THEN 'assistant' ELSE 'user' END
        || ':' || CASE WHEN audit[p] = 'I' THEN '' ELSE r.text END) END
  FROM f LEFT JOIN r ON f.g = r.g AND f.pos = r.pos WHERE p <= length(audit)),
h AS (SELECT g, sha256(array_to_string(lines, chr(10))) AS hash FROM f WHERE p = length(audit) + 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM c) a LEFT JOIN n ON a.g = n.g LEFT JOIN best ON a.g = best.g LEFT JOIN h ON a.g = h.g""",
    "op13_merkle": """
WITH RECURSIVE d AS (
  SELECT *, coalesce(':' || lang, '-') AS g,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
    || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
    || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents),
l AS (
  SELECT doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(lowered)) || ':' || lowered, '-')) AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (
  SELECT 0 AS lvl, g, idx, n, leaf AS h FROM r
  UNION ALL
  SELECT max(lvl) + 1, g, idx // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY g, idx // 8),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM s
  UNION ALL
  SELECT max(lvl) + 1, idx // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY idx // 8),
nodes AS (SELECT 0 AS tree, g, lvl, idx, n, h FROM t UNION ALL SELECT 1, '', lvl, idx, n, h FROM u),
sides AS (
  SELECT a.tree, a.g, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lefts,
    coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rights
  FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 AND a.idx <> b.idx
  WHERE a.n > 1 GROUP BY ALL),
c AS (SELECT doc_id, r.g, leaf, subroot, r.idx, s.idx AS sub_idx,
    (SELECT h FROM u WHERE n = 1) AS root,
    CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS first
  FROM r JOIN s ON r.g = s.g LEFT JOIN (
    SELECT id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]),
        lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc_
    , xor(crc_, 4294967295::UBIGINT) AS crc FROM (SELECT DISTINCT doc_id AS id FROM documents)) k ON k.id = r.doc_id),
f AS (
  SELECT doc_id, g, 0 AS tree, 0 AS lvl, idx, sub_idx, first AS h, '' AS proof FROM c
  UNION ALL
  SELECT f.doc_id, f.g,
    CASE WHEN x.g IS NULL THEN 1 ELSE f.tree END, CASE WHEN x.g IS NULL THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN x.g IS NULL THEN sub_idx ELSE f.idx // 8 END, sub_idx,
    CASE WHEN x.g IS NULL THEN f.h ELSE sha256(lefts || f.h || rights) END,
    CASE WHEN x.g IS NULL THEN proof ELSE proof || lefts || rights END
  FROM f LEFT JOIN sides x ON x.tree = f.tree AND x.g = CASE WHEN f.tree = 0 THEN f.g ELSE '' END AND x.lvl = f.lvl AND x.idx = f.idx
  WHERE x.g IS NOT NULL OR f.tree = 0),
e AS (SELECT doc_id, arg_max(h, tree * 1000 + lvl) AS folded_root, arg_max(proof, tree * 1000 + lvl) AS proof FROM f GROUP BY 1)
SELECT c.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM c JOIN e ON c.doc_id = e.doc_id""",
}


def queries() -> dict[str, Query]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
