"""DuckDB SQL for the operators that it can express over whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
    f AS (SELECT digest, min(page_id) AS head FROM h GROUP BY digest)
    SELECT page_id, n AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(digest, CAST((i // 4) * 5 + 1 AS INT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to
    FROM h JOIN f USING (digest)"""

OP2 = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM d),
    t AS (SELECT doc_id, line_no, list_sort(list_distinct(WORDS)) AS s FROM l),
    c AS (SELECT row_number() OVER () AS id, s, len(s) AS n, first FROM (SELECT s, min((doc_id, line_no)) AS first FROM t WHERE len(s) > 0 GROUP BY s)),
    tok AS (SELECT id, n, unnest(s) AS w FROM c), df AS (SELECT w, count(*) AS df FROM tok GROUP BY w),
    r AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS k FROM tok JOIN df USING (w)),
    p AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
    cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b USING (w) WHERE a.id <> b.id AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
    over AS (SELECT x, cy.first, len(list_intersect(cx.s, cy.s)) AS o, cx.n + cy.n AS size FROM cand JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y),
    near AS (SELECT x, min(first) AS first FROM over WHERE o >= 0.8 * (size - o) - 1e-9 GROUP BY x),
    best AS (SELECT c.s, CASE WHEN near.first < c.first THEN near.first ELSE c.first END AS b FROM c LEFT JOIN near ON x = id),
    gone AS (SELECT doc_id, list(line_no) AS g FROM t JOIN best USING (s) WHERE b < (doc_id, line_no) GROUP BY doc_id)
    SELECT doc_id, len(lines) AS n_lines, len(coalesce(g, [])) AS n_removed,
    sha256(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(coalesce(g, []), i - 1)), chr(10))) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)""".replace("WORDS", _WORDS.format("line"))

OP7 = r"""WITH RECURSIVE d AS (SELECT doc_id, text, WORDS AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
        UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y USING (text) WHERE x.doc_id < y.doc_id),
    ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
    SELECT a AS doc_id, min(b) AS class_id, min(b) = a AS is_first FROM reach GROUP BY a""".replace("WORDS", _WORDS.format("lower(text)"))

OP8 = r"""WITH d AS (SELECT doc_id, WORDS AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50),
    h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM i),
    f AS (SELECT h, min(doc_id) AS head FROM h GROUP BY h),
    hit AS (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN f USING (h) WHERE head < doc_id),
    gone AS (SELECT doc_id, list(DISTINCT k) AS g FROM hit GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, len(coalesce(g, [])) AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(g, []), i)), ' ')) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)""".replace("WORDS", _WORDS.format("coalesce(text, '')"))

OP11 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b, p.score, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON s.a = p.a WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT a AS anchor_id, b AS positive_id, rank::INT AS rank, neg AS negative_id, score AS positive_score, ns AS negative_score FROM n WHERE rank <= 5"""

OP12 = r"""WITH RECURSIVE d AS (SELECT doc_id, WORDS AS ws FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b)
    SELECT a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a""".replace(
    "WORDS", _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
)
