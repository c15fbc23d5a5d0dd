"""DuckDB SQL for the contract of queries whose method differs but whose result SQL can state exactly."""

from __future__ import annotations

#: Smallest id that each row of ``ids`` reaches over ``edges`` (a, b, both directions): only smaller ids travel on.
_REACH = """reach AS (SELECT id AS node, id AS comp FROM ids UNION SELECT e.b, r.comp FROM reach r JOIN edges e ON e.a = r.node WHERE r.comp < e.b),
    comps AS (SELECT node, min(comp) AS comp FROM reach GROUP BY 1)"""

OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
    SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d"""

OP9_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)])) END AS s FROM words),
    classes AS (SELECT min(doc_id) AS id, s FROM sets WHERE len(s) > 0 GROUP BY s), ids AS (SELECT id FROM classes),
    x AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM classes),
    pairs AS (SELECT p.id AS a, q.id AS b, any_value(p.n) AS n, any_value(q.n) AS m, count(*) AS k FROM x p JOIN x q ON p.shingle = q.shingle AND p.id < q.id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) GROUP BY 1, 2),
    near AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n + m - k)), edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), {_REACH}
    SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN comps ON node = id"""

OP10_SQL = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([z FOR z IN embedding IF z IS NULL OR NOT isfinite(z)]) = 0 AND len([z FOR z IN embedding IF z <> 0]) > 0),
    edges AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM ids p JOIN ids q ON p.label = q.label AND p.id <> q.id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.93), {_REACH},
    degree AS (SELECT a, count(*) AS n FROM edges GROUP BY 1)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(comp, vec_id) AS component_id, vec_id = coalesce(comp, vec_id) AS kept FROM embeddings LEFT JOIN comps ON node = vec_id LEFT JOIN degree ON a = vec_id"""

#: One step of CRC-32 for each byte, as a list.
_STEPS = """t AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y : CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS step FROM range(256) r(i))"""


def _crc32(s: str) -> str:
    """CRC-32 of the UTF-8 bytes of an expression, where ``t`` is at hand."""
    data = f"[('0x' || substr(hex(encode({s})), (2 * i + 1)::INT, 2))::BIGINT FOR i IN range(octet_length(encode({s})))]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda x, y : xor(x >> 8, step[(xor(x, y) & 255) + 1])), 4294967295)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""WITH {_STEPS}, x AS (SELECT doc_id AS id, true AS mine, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
    w AS (SELECT id, mine, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
    f AS (SELECT id, mine, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS f FROM w),
    n AS (SELECT id, mine, f, count(*) AS n FROM f GROUP BY ALL),
    h AS (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM n) q, t),
    b AS (SELECT bucket, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM n JOIN h USING (f) GROUP BY 1),
    g2 AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS gain FROM b, (SELECT sum(s) AS s_all, sum(t) AS t_all FROM b) q),
    d AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN h USING (f) JOIN g2 USING (bucket) WHERE mine GROUP BY 1),
    e AS (SELECT doc_id, len(w.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
          (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
          FROM documents LEFT JOIN w ON mine AND w.id = doc_id LEFT JOIN d ON d.id = doc_id),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_words >= 20)
    SELECT e.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)"""

OP13_SQL = rf"""WITH RECURSIVE {_STEPS}, r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
    h AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM c, t),
    d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
    x AS MATERIALIZED (SELECT word, n, length(word) AS l, unnest(range(1, length(word) + 1)) AS i FROM w), k AS MATERIALIZED (SELECT word, n, l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM x),
    p AS (SELECT p.word AS a, q.word AS b FROM k p JOIN k q ON p.cut = q.cut AND p.i = q.i AND p.l = q.l AND p.word <> q.word
          UNION SELECT p.word, w.word FROM k p JOIN w ON p.cut = w.word UNION SELECT w.word, p.word FROM k p JOIN w ON p.cut = w.word),
    m AS MATERIALIZED (SELECT a, count(*) AS n_near, max(w.n) AS top, min(b) FILTER (w.n = top) AS form FROM (SELECT a, b, max(w.n) OVER (PARTITION BY a) AS top FROM p JOIN w ON w.word = b) p JOIN w ON w.word = b GROUP BY a),
    f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN m ON a = word),
    g AS (SELECT word, word AS at FROM f UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f e ON e.word = g.at AND e.form IS NULL"""
