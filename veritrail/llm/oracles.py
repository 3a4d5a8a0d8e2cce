"""SQL of the corpus queries that SQL can express."""

from veritrail.llm.urls import BLOCKED_HOSTS, RULES

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_HOSTS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"


#: crc32 of doc_id in decimal: eight steps for each of its characters, which are single bytes.
_BIT = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: {_BIT})), 4294967295)"
_AHEAD = "coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
_BEHIND = "coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"

SQL: dict[str, str] = {
    "op7_url_filter": f"""
        WITH rules(rh, rp, rv) AS (VALUES {_RULES}), hosts(bh) AS (VALUES {_HOSTS}),
        split AS (
            SELECT page_id,
                CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        fits AS (
            SELECT page_id, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(rv, (length(rh || rp), length(rh))) AS verdict
            FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT page_id, host, path, rule,
            coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM hosts WHERE host = bh OR ends_with(host, '.' || bh)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM split LEFT JOIN fits USING (page_id)""",
    "op12_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE f AS (SELECT *, translate(text, chr(10), '') AS cut FROM documents),
        e AS (SELECT doc_id, source, {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head, {_field("text")} AS body, {_field("cut")} AS cut_body FROM f),
        l AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN {_CRC32} % 2 = 0 THEN sha256(head || cut_body) ELSE sha256(head || body) END AS claim FROM e),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
        t AS (SELECT source, 0 AS level, pos, n, leaf AS digest FROM p
            UNION ALL SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, level, pos // 3, (n + 2) // 3),
        s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS gid, count(*) OVER () AS n FROM t WHERE n = 1),
        c AS (SELECT 0 AS level, gid AS pos, n, subroot AS digest FROM s
            UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM c WHERE n > 1 GROUP BY level, pos // 3, (n + 2) // 3),
        a AS (SELECT source, level, pos, {_AHEAD} AS pre, {_BEHIND} AS post FROM t WHERE n > 1 WINDOW w AS (PARTITION BY source, level, pos // 3 ORDER BY pos)),
        b AS (SELECT level, pos, {_AHEAD} AS pre, {_BEHIND} AS post FROM c WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 3 ORDER BY pos)),
        g AS (SELECT source, pos AS row, pos, 0 AS level, claim AS acc, '' AS proof FROM p
            UNION ALL SELECT g.source, row, g.pos // 3, g.level + 1, sha256(pre || acc || post), proof || pre || post FROM g JOIN a ON g.source IS NOT DISTINCT FROM a.source AND g.level = a.level AND g.pos = a.pos),
        h AS (SELECT source, row, max_by(acc, level) AS acc, max_by(proof, level) AS proof FROM g GROUP BY source, row),
        k AS (SELECT h.source, row, gid AS pos, 0 AS level, acc, proof, subroot FROM h JOIN s ON h.source IS NOT DISTINCT FROM s.source
            UNION ALL SELECT source, row, k.pos // 3, k.level + 1, sha256(pre || acc || post), proof || pre || post, subroot FROM k JOIN b ON k.level = b.level AND k.pos = b.pos),
        r AS (SELECT source, row, max_by(acc, level) AS folded_root, max_by(proof, level) AS proof, any_value(subroot) AS subroot FROM k GROUP BY source, row)
        SELECT doc_id, leaf, subroot, (SELECT digest FROM c WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM c WHERE n = 1) AS verified
        FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source AND pos = row""",
    "op13_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS q FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        n AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
        FROM n JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3""",
}
