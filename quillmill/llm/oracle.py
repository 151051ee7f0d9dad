"""DuckDB SQL for the llm queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

TOPK = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.n AS query_row, q.vec_id AS query_id, c.vec_id, c.n,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.n <> q.n
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, n) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Product codes: each round assigns all parts, then moves the entries that have members."""
    steps = [
        f"""q AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, vec_id, label, v, len(v) // {parts} AS step
    FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )
), pieces AS (
    SELECT n, t.p, step, list_slice(v, t.p * step + 1, (t.p + 1) * step) AS x FROM q, range({parts}) AS t(p)
), b0 AS (SELECT p, n - 1 AS e, x AS c FROM pieces WHERE n <= {entries})"""
    ]

    def assigned(k: int) -> str:
        return f"""a{k} AS (
    SELECT n, p, any_value(x) AS x, any_value(step) AS step, min(d) AS d, arg_min(e, d * {entries} + e) AS e
    FROM (SELECT n, p, x, step, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM pieces JOIN b{k} USING (p))
    GROUP BY n, p
)"""

    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""m{k} AS (
    SELECT p, e, list(m ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, x, unnest(range(1, step + 1)) AS i FROM a{k}) GROUP BY p, e, i)
    GROUP BY p, e
), b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    steps.append(assigned(rounds))
    return f"""
WITH {", ".join(steps)}, coded AS (
    SELECT n, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n
), books AS (
    SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN q USING (n), books
"""


TRIE = """
WITH ordered AS (
    SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, list(t ORDER BY turn NULLS FIRST, r, x) AS ts FROM ordered GROUP BY conv_id
), summed AS (
    SELECT conv_id, ts, list_reduce(
        list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ) AS crc
    FROM convs
), heads AS (
    SELECT conv_id, ts, CAST(xor(crc, 4294967295) % 4 AS INTEGER) AS h FROM summed
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, c.h), []), coalesce(list_slice(c.ts, c.h + 1, len(c.ts)), [])) AS ts
    FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
    SELECT conv_id, d AS depth, list_slice(ts, 1, d) AS seq, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT seq, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY seq, depth
), counted AS (
    SELECT n.*, list_slice(n.seq, 1, n.depth - 1) AS up, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.seq[n.depth].text, '[^ \t-\r]+')) END AS own FROM nodes n
), children AS (
    SELECT up AS seq, depth - 1 AS depth, count(*) AS n_children FROM counted WHERE depth > 0 GROUP BY up, depth
), full_nodes AS (
    SELECT c.*, coalesce(k.n_children, 0) AS n_children FROM counted c LEFT JOIN children k ON k.depth = c.depth AND k.seq = c.seq
), below AS (
    SELECT list_slice(seq, 1, a) AS seq, a AS depth, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM (SELECT seq, own, n_children, unnest(range(0, depth + 1)) AS a FROM full_nodes) GROUP BY list_slice(seq, 1, a), a
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON b.depth = n.depth AND b.seq = n.seq LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.seq = n.up
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_topk": TOPK, "op11_vector_codes": _codes(), "op13_prefix_trie": TRIE}
