"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .secret_scan import BASE
from .sharding import PRIME, SLOT_ROWS, _coefficients


def _secret_sql() -> str:
    parts = []
    for number, rule in enumerate(BASE):
        pattern = rule.pattern.replace("'", "''")
        measured = f"length(regexp_extract(m, '{pattern}', {rule.group}))" if rule.group else "length(m)"
        parts.append(f"""
        SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {measured} >= {rule.least} AS counts, length(m) AS size,
            sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY place) AS stop
        FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS place, unnest(ms) AS m, unnest(list_transform(ps[:len(ms)], lambda x: length(x))) AS gap
            FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}', 0) AS ms, string_split_regex(body, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)""")
    union = "\n        UNION ALL".join(parts)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    f AS (SELECT doc_id, kind, number, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM ({union}) WHERE counts),
    s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob_sha256
    FROM d LEFT JOIN s USING (doc_id)"""


def _crc_table() -> str:
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ 0xEDB88320 if i & 1 else i >> 1
        table.append(i)
    return f"{table}::BIGINT[]"


_BYTES = "list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda b: ('0x' || b)::BIGINT)"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _shard_sql() -> str:
    def best(n: int) -> str:
        scores = []
        for i in range(n):
            a, b, c = _coefficients(0, i)
            scores.append(f"(x * {a} % {PRIME} + y * {b} % {PRIME} + {c}) % {PRIME}")
        # 1 / -ln(u) rises with u, so the greatest u wins
        return f"(list_position([{', '.join(scores)}], list_max([{', '.join(scores)}])) - 1)::INTEGER"

    return f"""
    WITH t AS (SELECT {_crc_table()} AS crc_table),
    h AS (SELECT doc_id, coalesce(text, '') AS body, md5('k' || doc_id) AS h FROM documents),
    k AS (SELECT doc_id, body, ('0x' || h[1:8])::BIGINT % {PRIME} AS x, ('0x' || h[9:16])::BIGINT % {PRIME} AS y FROM h),
    p AS (SELECT doc_id, strlen(body) + 1 AS size, {_CRC} AS text_crc32, x, {best(16)} AS shard, {best(17)} AS grown_shard FROM k, t),
    n AS (SELECT greatest(1, ceil(count(*) / {SLOT_ROWS}))::BIGINT AS buckets FROM documents)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard,
        (row_number() OVER (PARTITION BY shard ORDER BY (x + text_crc32) % buckets, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
    FROM p, n"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_REACH = """
    r AS (SELECT id, id AS low FROM nodes UNION SELECT l.b, r.low FROM r JOIN links l ON l.a = r.id WHERE r.low < l.b),
    least AS (SELECT id, min(low) AS low FROM r GROUP BY id)"""

NEAR_DEDUP = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS ss FROM w),
    nodes AS (SELECT doc_id AS id, len(ss) AS n FROM s),
    e AS (SELECT doc_id AS id, unnest(ss) AS x FROM s),
    c AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.id <> q.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM c JOIN nodes p ON p.id = a JOIN nodes q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
    {_REACH},
    g AS (SELECT s.doc_id, list_sort(ss) AS key FROM s WHERE len(ss) > 0),
    m AS (SELECT key, count(*) AS n_copies FROM g GROUP BY key)
    SELECT nodes.id AS doc_id, nodes.n::BIGINT AS n_shingles, low AS component_id, low = nodes.id AS kept, coalesce(n_copies, 1)::BIGINT AS n_copies
    FROM nodes JOIN least ON least.id = nodes.id LEFT JOIN g ON g.doc_id = nodes.id LEFT JOIN m ON m.key = g.key"""

EMBEDDINGS = f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    ok AS (SELECT * FROM nodes WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.id <> q.id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.95),
    {_REACH},
    d AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT nodes.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, low = nodes.id AS kept
    FROM nodes JOIN least ON least.id = nodes.id LEFT JOIN d ON d.a = nodes.id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secret_scan": _secret_sql(),
        "op6_rendezvous_shards": _shard_sql(),
        "op7_minhash_near_dedup": NEAR_DEDUP,
        "op9_embedding_near_dedup": EMBEDDINGS,
    }
