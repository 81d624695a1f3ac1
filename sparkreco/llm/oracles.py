"""DuckDB SQL for the operators that SQL can express on small tables; joins on hashes and signatures are plain joins here."""

KNN = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: For pages whose article is one <article> element: its text is the main text.
HTML = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
u AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM u
"""

SUFFIX = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n, h FROM b),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM p WHERE n >= 50)),
f AS (SELECT hash(w) AS k, w, min(doc_id) AS first FROM s GROUP BY w),
r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (w) WHERE f.first < s.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS opens FROM r),
q AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
z AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS e FROM q GROUP BY 1, 2),
l AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM z),
k AS (SELECT p.doc_id, p.n, coalesce(sum(e - a), 0) AS n_removed, count(l.a) AS n_spans,
  coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN next IS NULL THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY a), any_value(h)) AS kept
  FROM p LEFT JOIN l USING (doc_id) GROUP BY p.doc_id, p.n)
SELECT doc_id, n AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""

REPEATS = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE t IN (SELECT t FROM s GROUP BY t HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(0, 35)) AS o)),
k AS (SELECT w.doc_id, array_to_string(list(u.word ORDER BY u.i) FILTER (c.i IS NULL), ' ') AS kept, count(c.i) AS n_removed
  FROM w JOIN (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) u USING (doc_id) LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""


def _merkle(levels: int = 6, over: int = 3, fanout: int = 16) -> str:
    """Trees of up to fanout ** levels rows a source and fanout ** over sources, level by level."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    # the checksum's polynomial, bit by bit over the digits
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: list_reduce(range(8), lambda b, x: xor(b // 2, CASE WHEN b % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, c)), CAST(4294967295 AS BIGINT)), 4294967295)"
    parts = [
        f"d AS (SELECT *, {hashed('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents)",
        "p AS (SELECT doc_id, source AS g, leaf, coalesce(changed, leaf) AS f, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT g, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p)",
        "p0 AS (SELECT * FROM p)",
    ]
    up = "SELECT g, i // {f} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + {f} - 1) // {f} AS n FROM {n} GROUP BY g, i // {f}"
    run = "SELECT g, i // {f} AS i, list(h ORDER BY i) AS hs, any_value(n) AS n FROM {n} GROUP BY g, i // {f}"
    step = "SELECT p.* EXCLUDE (f, proof, i), CASE WHEN r.n > 1 THEN sha256(array_to_string(hs[1:p.i % {f}], '') || p.f || array_to_string(hs[p.i % {f} + 2:], '')) ELSE p.f END AS f, proof || array_to_string(hs[1:p.i % {f}], '') || array_to_string(hs[p.i % {f} + 2:], '') AS proof, p.i // {f} AS i FROM {p} p JOIN {r} r ON p.g IS NOT DISTINCT FROM r.g AND p.i // {f} = r.i"
    for prefix, count in (("", levels), ("t", over)):
        for k in range(count):
            n, r, p = f"{prefix}n{k}", f"{prefix}r{k}", f"{prefix}p{k}"
            parts += [f"{r} AS ({run.format(f=fanout, n=n)})", f"{prefix}p{k + 1} AS ({step.format(f=fanout, p=p, r=r)})", f"{prefix}n{k + 1} AS ({up.format(f=fanout, n=n)})"]
        if not prefix:
            parts += [
                f"s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM n{count})",
                "tn0 AS (SELECT 0 AS g, i, subroot AS h, n FROM s)",
                f"tp0 AS (SELECT doc_id, leaf, f, proof, subroot, 0 AS g, s.i FROM p{count} p JOIN s ON p.g IS NOT DISTINCT FROM s.source)",
            ]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM tp{over} JOIN tn{over} USING (g)"


MERKLE = _merkle()
