"""DuckDB statements for the queries that SQL can express."""

from millrace.llm.licenses import license_sql

SQL_op4_license_scan = license_sql()

SQL_op7_chat_formatting = r"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\t') AS body,
        replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS head
    FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

SQL_chat_mixed_layouts = r"""
WITH r AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN (conv_id % 3 + 3) % 3 = 1 THEN 'from_value' WHEN (conv_id % 3 + 3) % 3 = 2 AND len(t) = 2 AND t[1].role = 'user' AND t[2].role = 'assistant' THEN 'prompt_completion' ELSE 'messages' END AS layout,
    len(t)::BIGINT AS n_turns, sha256(array_to_string(list_transform(t, lambda x: x.role || chr(10) || x.text || chr(10)), '')) AS turns_sha256
FROM r
"""

SQL_op10_warc_index = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
k AS (SELECT s, max(page_id) AS m FROM p GROUP BY s)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(s, (1 + 5 * (i // 4))::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN k USING (s)
"""

SQL_op9_nearest_neighbours = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
) WHERE rank <= 20
"""
