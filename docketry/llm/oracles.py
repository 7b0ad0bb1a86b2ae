"""DuckDB SQL for the queries that SQL can express.

Token counts and BPE (merge loops), secrets and personal data (spans of a tagger), and the classifier (training) have
none; tests hold them against the libraries, plain regexes, brute force and held-out labels.
"""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM p),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
kept AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.j) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM d) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.j = g.j GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op7(control: tuple[str, ...], marks: int) -> str:
    """marks: characters of a turn's three marks. Of an escaped text only the length matters here: a backslash is doubled, a control string grows by one."""
    grown = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in (*control, "\\"))
    return rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, (SELECT length(x) + {grown} FROM (SELECT text AS x)) + (SELECT length(x) + {grown} FROM (SELECT role AS x)) + {marks} AS chars FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM l GROUP BY conv_id
"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT p.doc_id, win.n, p.i, item_id FROM places p JOIN win ON p.k = win.k AND p.n = win.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id),
from_item AS (SELECT x, item_id, i, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT row_number() OVER () AS x, item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
met AS (SELECT p.doc_id, p.i, f.x, f.item_id::VARCHAR AS item, f.i AS j, f.n FROM places p JOIN from_item f ON p.k = f.k AND p.n = f.n),
runs AS (SELECT doc_id, item, n + count(*) - 1 AS words, min(i) - 1 AS pos, min(j) - 1 AS item_at FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, x, i - j ORDER BY i) AS g FROM met) GROUP BY doc_id, x, item, n, i - j, g),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos, item NULLS LAST, item_at) AS r FROM runs) WHERE r = 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest.words, 0)::BIGINT AS longest_hit, longest.pos::BIGINT AS longest_at, longest.item AS longest_item, longest.item_at::BIGINT AS longest_item_at
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
