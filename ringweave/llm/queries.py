"""Registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ringweave.llm import ann, bpe, disclosure, html_extract, langid, maxent_lm, mixing, prefix_trie, simhash, token_count, token_pack, vector_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extract.op1,
    "op2_mixing_sources": mixing.op2,
    "op3_token_output": token_pack.op3,
    "op4_embedding_near_dedup": vector_dedup.op4,
    "op5_token_counts": token_count.op5,
    "op6_language_id": langid.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_lm_scoring": maxent_lm.op8,
    "op9_bpe_encoding_decoding": bpe.op9,
    "op10_nearest_neighbours": ann.op10,
    "op11_pii_disclosure": disclosure.op11,
    "op12_conversation_trie": prefix_trie.op12,
    "op13_embedding_whitening": whitening.op13,
    "pipeline": corpus_pipeline.run,
}
USABLE = """
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

# crc32 of each id, byte by byte from a table made by its rule, then every prefix as a list of turns
TRIE = """
    WITH RECURSIVE bits(i, v, k) AS (
        SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
        UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT i, v FROM bits WHERE k = 8),
    steps(c, s, pos, v) AS (
        SELECT conv_id, conv_id::VARCHAR, 1, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
        UNION ALL SELECT c, s, pos + 1, xor(crc.v, steps.v >> 8) FROM steps JOIN crc ON crc.i = xor(steps.v & 255, ord(substr(s, pos, 1))) WHERE pos <= length(s)),
    convs AS (SELECT c, xor(v, 4294967295) % 6 AS h, c - c % 100 AS base FROM steps WHERE pos = length(s) + 1),
    turns AS (SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
              FROM conversations WHERE conv_id IS NOT NULL),
    lists AS (SELECT c, list(x ORDER BY i) AS xs FROM turns GROUP BY c),
    built AS (SELECT convs.c, list_concat(coalesce(b.xs, [])[1:h], own.xs[h + 1:]) AS xs FROM convs JOIN lists own USING (c) LEFT JOIN lists b ON b.c = base),
    visits AS (SELECT c, d, xs[1:d] AS p, d = len(xs) AS ends FROM (SELECT c, xs, unnest(range(len(xs) + 1)) AS d FROM built)),
    nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS h,
                     CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[-1].t) END AS saved FROM visits GROUP BY d, p),
    kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
    below AS (SELECT up.d, up.p, count(*) FILTER (kids.k IS NULL) AS leaves, sum(x.saved) AS saved
              FROM (SELECT d, p, saved, unnest(range(d + 1)) AS a FROM nodes) x JOIN nodes up ON up.d = a AND up.p = x.p[1:a] LEFT JOIN kids ON kids.d = x.d AND kids.p = x.p GROUP BY up.d, up.p)
    SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, n.h AS ends_sha256
    FROM nodes n JOIN below ON below.d = n.d AND below.p = n.p LEFT JOIN kids ON kids.d = n.d AND kids.p = n.p LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
LETTERS = r"[\p{L}\p{M}]"
# finds with the plain patterns, then the counts and shares of terms near them
DISCLOSURE = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    cuts AS (
        SELECT r, 0 AS k, 'email' AS kind, regexp_extract_all(text, '{EMAIL}') AS ms, regexp_split_to_array(text, '{EMAIL}') AS gs FROM d
        UNION ALL SELECT r, 1, 'ip', regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), regexp_split_to_array(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
        UNION ALL SELECT r, 2, 'card', regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), regexp_split_to_array(text, '[0-9]([\x20-]?[0-9])+') FROM d
        UNION ALL SELECT r, 3, 'phone', regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_split_to_array(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
    each AS (SELECT r, k, kind, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM cuts WHERE len(ms) > 0),
    placed AS (SELECT r, k, kind, ms[i] AS m, regexp_replace(ms[i], '[^0-9]', '', 'g') AS n, gs[i] AS before, gs[i + 1] AS after,
                      list_sum(list_transform(gs[1:i] || ms[1:i], lambda x: length(x)))::BIGINT AS stop FROM each),
    finds AS (SELECT *, stop - length(m) AS start, k || ':' || CASE k WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE n END AS entity FROM placed
              WHERE CASE k WHEN 0 THEN true WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS INTEGER) <= 255, false)))
                    WHEN 2 THEN length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse(n), j, 1)::INT
                         ELSE (substr(reverse(n), j, 1)::INT * 2) // 10 + (substr(reverse(n), j, 1)::INT * 2) % 10 END)) % 10 = 0
                    ELSE length(n) BETWEEN 10 AND 15 END),
    near AS (SELECT r, entity, regexp_replace(CASE WHEN length(before) > 120 THEN regexp_replace(right(before, 121), '^{LETTERS}+', '') ELSE before END || ' ' ||
                    CASE WHEN length(after) > 120 THEN regexp_replace(left(after, 121), '{LETTERS}+$', '') ELSE after END, '{EMAIL}', ' ', 'g') AS c FROM finds),
    pairs AS (SELECT DISTINCT r, entity, unnest(regexp_extract_all(lower(c), '{LETTERS}{{3,}}')) AS term FROM near),
    together AS (SELECT entity, term, count(*) AS nb FROM pairs JOIN d USING (r) GROUP BY 1, 2 HAVING count(DISTINCT text) >= 3),
    terms AS (SELECT term, count(*) AS nt FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(regexp_replace(text, '{EMAIL}', ' ', 'g')), '{LETTERS}{{3,}}')) AS term FROM d) GROUP BY 1),
    known AS (SELECT entity, count(DISTINCT r) AS ne FROM finds GROUP BY 1),
    shares AS (SELECT entity, term, log2(n::DOUBLE * nb / ne / nt) / log2(n::DOUBLE / ne) AS share
               FROM together JOIN terms USING (term) JOIN known USING (entity), (SELECT count(*) AS n FROM d) WHERE ne < n),
    marked AS (SELECT r, term, max(share) AS share FROM pairs JOIN shares USING (entity, term) WHERE share >= 0.8 GROUP BY 1, 2),
    tokens AS (SELECT r, regexp_extract_all(text, '{EMAIL}|{LETTERS}+') AS ms, regexp_split_to_array(text, '{EMAIL}|{LETTERS}+') AS gs FROM d WHERE r IN (SELECT r FROM marked)),
    words AS (SELECT r, ms[i] AS m, list_sum(list_transform(gs[1:i] || ms[1:i], lambda x: length(x)))::BIGINT AS stop FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM tokens)),
    spans AS (SELECT r, start, k, kind, stop FROM finds
              UNION ALL SELECT r, stop - length(m), CASE WHEN share >= 0.95 THEN 5 ELSE 4 END, CASE WHEN share >= 0.95 THEN 'removed' ELSE 'generalised' END, stop
              FROM words JOIN marked USING (r) WHERE lower(m) = term)
    SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
           sha256(coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k, stop) FILTER (k < 4), '')) AS base_sha256,
           coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k, stop), '') AS spans
    FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""

# The others tokenize, train or draw, which SQL cannot express; tests/llm holds them against brute force.
# Answers of op10 are those found; on tables of a few thousand vectors its probes reach every bucket.
ORACLES: dict[str, str] = {
    "op4_embedding_near_dedup": f"""
        WITH RECURSIVE {USABLE},
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        sums AS (SELECT a, count(*) AS n FROM links GROUP BY a),
        least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT t.vec_id, coalesce(n, 0) AS n_links, least(t.vec_id, coalesce(m, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(m, t.vec_id)) AS kept
        FROM embeddings t LEFT JOIN sums ON t.vec_id = sums.a LEFT JOIN least_of ON t.vec_id = least_of.a
    """,
    "op10_nearest_neighbours": f"""
        WITH {USABLE},
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM pairs)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 10
    """,
    "op11_pii_disclosure": DISCLOSURE,
    "op12_conversation_trie": TRIE,
} | ({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})
