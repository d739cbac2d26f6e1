"""DuckDB SQL of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, s, s + least(13, len(w)) - 1) AS t, least(13, len(w)) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
),
grams AS (
  SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
),
hits AS (SELECT g.doc_id, g.s, g.k, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.t = win.t),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_CONTROL = ("\\", "<s>", "</s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escapes(column: str) -> str:
    """How many escapes the column's text needs: one per control string and backslash."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{x}', ''))) // {len(x)}" for x in _CONTROL)


OP4 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 13 + {_escapes('role')} + {_escapes('text')}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _field(column: str, number: bool = False) -> str:
    text = f"CAST({column} AS VARCHAR)" if number else column
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({_field('doc_id', True)} || {_field('source')} || {_field('lang')} || {_field('n_chars', True)} || {_field(text)})"


# CRC-32 of decimal digits: byte by byte, bit by bit, on the reflected polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _tree(name: str, source: str) -> str:
    """All levels of the lists of ``source`` (g, pos, n, h), and the runs of siblings."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, pos, n, h FROM {source}
  UNION ALL
  SELECT g, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16
),
{name}_runs AS (SELECT g, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 16)"""


def _walk(name: str, source: str, runs: str) -> str:
    """From rows (id, g, lvl, pos, cur, proof) up to the top of their list."""
    before, after = "array_to_string(hs[:pos % 16], '')", "array_to_string(hs[pos % 16 + 2:], '')"
    return f"""
{name} AS (
  SELECT id, g, lvl, pos, cur, proof FROM {source}
  UNION ALL
  SELECT id, w.g, w.lvl + 1, pos // 16, sha256({before} || cur || {after}), proof || {before} || {after}
  FROM {name} w JOIN {runs} r ON w.g = r.g AND w.lvl = r.lvl AND w.pos // 16 = r.run
),
{name}_top AS (SELECT id, g, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM {name} GROUP BY id, g)"""


OP11 = rf"""
WITH RECURSIVE
told AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
leaves AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS g, {_leaf('text')} AS h, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf('low')} END AS altered FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{_tree('own', 'placed')},
subroots AS (SELECT '' AS g, g AS source, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM own WHERE n = 1),
{_tree('tops', 'subroots')},
the_root AS (SELECT h AS root FROM tops WHERE n = 1),
begun AS (SELECT id, g, 0::BIGINT AS lvl, pos, coalesce(altered, h) AS cur, '' AS proof FROM placed),
{_walk('up', 'begun', 'own_runs')},
risen AS (SELECT id, '' AS g, 0::BIGINT AS lvl, s.pos, cur, proof FROM up_top u JOIN subroots s ON u.g = s.source),
{_walk('over', 'risen', 'tops_runs')}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, root, sha256(o.proof) AS proof_sha256, o.cur AS folded_root, o.cur = root AS verified
FROM placed p JOIN over_top o ON p.id = o.id JOIN subroots s ON p.g = s.source CROSS JOIN the_root
"""


def _op12(rounds: int = 10) -> str:
    parts = ["""kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)""", """c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 8)
)"""]
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (
  SELECT id, vec_id, v, b.j, b.d FROM (
    SELECT k.id, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(d := {distance}, j := c.j)) AS b FROM kept k CROSS JOIN c{r} c GROUP BY k.id)
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY j, i) GROUP BY j) m ON c.j = m.j
)""")
    return f"""WITH {', '.join(parts)}
SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.j = c.j"""


ORACLES = {"op4_chat_formatting": OP4, "op10_decontamination": OP10, "op11_merkle_manifest": OP11, "op12_shallot_clusters": _op12()}
