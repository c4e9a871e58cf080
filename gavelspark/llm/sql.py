"""DuckDB SQL equal to those of the pN_ queries that SQL can express on whole tables.

The others are tested against brute force, libraries of their own or exact round trips in tests/llm.
"""

from __future__ import annotations

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def _shingles(relation: str) -> str:
    """Distinct shingles (id, s) of a relation with columns id and text."""
    split = f"SELECT id, {_TOKENS} AS t FROM {relation}"
    return f"SELECT DISTINCT id, concat(t[i], chr(31), t[i + 1], chr(31), t[i + 2]) AS s FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM ({split}) a) b"


_PROGRAMS = """SELECT DISTINCT list_id, pos, candidates[pos + 1] AS text FROM (SELECT list_id, candidates, unnest(range(0, len(candidates))) AS pos FROM evaluate) z WHERE candidates[pos + 1] IS NOT NULL"""

_SIMILAR = f"""programs AS (SELECT (list_id, pos) AS id, text FROM ({_PROGRAMS}) z),
shingles AS ({_shingles('programs')}),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE c >= CAST(0.6 AS DOUBLE) * (x.n + y.n - c))"""

_P5 = f"WITH {_SIMILAR} SELECT a[1] AS list_a, CAST(a[2] AS INT) AS pos_a, b[1] AS list_b, CAST(b[2] AS INT) AS pos_b FROM near"

_P1 = f"""WITH {_SIMILAR},
lists AS (SELECT DISTINCT e.list_id, coalesce(e.split = 'train', false) AS train, coalesce(n.canonical, e.language) AS language, e.query, len(e.candidates) AS n FROM evaluate e LEFT JOIN language_names n ON n.spelling = e.language WHERE e.list_id IS NOT NULL),
queries AS (SELECT list_id AS id, query AS text FROM lists WHERE query IS NOT NULL),
qs AS ({_shingles('queries')}),
qn AS (SELECT id, count(*) AS n FROM qs GROUP BY id),
pairs AS (SELECT x.list_id AS a, y.list_id AS b, x.n AS na, y.n AS nb FROM (SELECT a.id AS a, b.id AS b, count(*) AS c FROM qs a JOIN qs b ON a.s = b.s AND a.id < b.id GROUP BY ALL) q JOIN qn m ON m.id = q.a JOIN qn k ON k.id = q.b JOIN lists x ON x.list_id = q.a JOIN lists y ON y.list_id = q.b
  WHERE c >= CAST(0.6 AS DOUBLE) * (m.n + k.n - c) AND x.train <> y.train AND x.language = y.language),
pairwise AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
met AS (SELECT p.a, p.b, count(DISTINCT s.a[2]) AS ma, count(DISTINCT s.b[2]) AS mb FROM pairs p JOIN pairwise s ON s.a[1] = p.a AND s.b[1] = p.b GROUP BY ALL)
SELECT p.a AS list_a, p.b AS list_b FROM pairs p JOIN met USING (a, b) WHERE (na > nb OR 2*ma >= na) AND (nb > na OR 2*mb >= nb)"""

_P2_GAMES = """WITH once AS (SELECT list_id, i, j, winner FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY list_id, i, j, winner) AS rn FROM ranking_consistency WHERE (winner = i OR winner = j) AND i <> j AND list_id IS NOT NULL) z WHERE rn = 1 OR record_id IS NULL),
owner AS (SELECT list_id, pos, min(policy) AS policy FROM candidate_policies GROUP BY ALL),
named AS (SELECT w.policy AS w, l.policy AS l FROM once o JOIN owner w ON w.list_id = o.list_id AND w.pos = o.winner JOIN owner l ON l.list_id = o.list_id AND l.pos = CASE WHEN o.winner = o.i THEN o.j ELSE o.i END)
SELECT least(w, l) AS x, greatest(w, l) AS y, count(*) FILTER (w < l) AS wins, count(*) FILTER (w > l) AS losses FROM named WHERE w <> l GROUP BY ALL"""

_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))"


def _runs(relation: str, key: str) -> str:
    """Distinct runs of 13 words (id, run) of a relation with column text."""
    return f"SELECT DISTINCT id, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key} AS id, {_WORDS} AS w FROM {relation}) a) b"


_P7 = f"SELECT DISTINCT d.id AS doc_id, h.id AS item_id FROM ({_runs('documents', 'doc_id')}) d JOIN ({_runs('heldout_items', 'item_id')}) h ON d.run = h.run"

_P1_REPORT = f"""SELECT split, source, count(DISTINCT other_id) AS lists, count(*) AS pairs
FROM (SELECT CASE WHEN t.list_id IS NULL THEN list_a ELSE list_b END AS other_id FROM ({_P1}) f LEFT JOIN (SELECT DISTINCT list_id FROM evaluate WHERE split = 'train') t ON t.list_id = f.list_a) o
JOIN (SELECT list_id AS other_id, split, source FROM (SELECT list_id, split, source, row_number() OVER (PARTITION BY list_id ORDER BY split NULLS FIRST, source NULLS FIRST) AS rn FROM evaluate) z WHERE rn = 1) e USING (other_id) GROUP BY split, source"""

SQL: dict[str, str] = {
    "p1_found": _P1,
    "p1_report": _P1_REPORT,
    "p2_games": _P2_GAMES,
    "p5_found": _P5,
    "p7_found": _P7,
    "p7_report": f"SELECT item_id, count(*) AS documents, count(DISTINCT source) AS sources FROM ({_P7}) f JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) d USING (doc_id) GROUP BY item_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
