"""How queries are registered with their SQL, and the SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


#: Sequences: letters of each run of 20 words.
SEQS = r"""
w AS (SELECT doc_id, lang AS grp, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (SELECT doc_id, grp, ws, unnest(range(0, ((len(ws) - 1) // 20 + 1)::BIGINT)) AS run FROM w WHERE len(ws) > 0),
seqs AS MATERIALIZED (SELECT * FROM (SELECT doc_id * 1000000 + run AS seq_id, doc_id, grp, upper(regexp_replace(array_to_string(ws[run * 20 + 1 : run * 20 + 20], ''), '[^A-Za-z]', '', 'g')) AS seq FROM runs) WHERE seq <> '')"""

DRAW = "(('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::BIGINT / 4294967296::DOUBLE)"

_SITES = "list_filter(range(1, length(seq) + 1), lambda p: substr(seq, p, 1) IN ('K', 'R') AND substr(seq, p + 1, 1) <> 'P')"
_KEEP = "lambda p: " + DRAW.format("42, seq_id, replica, p") + " > CASE WHEN substr(seq, p, 1) = 'K' THEN 0.3::DOUBLE * 1.5::DOUBLE ELSE 0.3::DOUBLE END"

#: Three replicas of fragments by the first rule; prim is replica 0, known has the last place of equal fragments.
FRAGS = SEQS + f""",
sited AS (SELECT seq_id, grp, seq, {_SITES} AS sites FROM seqs),
cut AS (SELECT seq_id, grp, seq, replica, list_filter(sites, {_KEEP}) AS cuts FROM sited, range(3) t(replica)),
pieces AS (SELECT seq_id, grp, seq, replica, unnest(list_concat([0], cuts)) AS b, unnest(list_concat(cuts, [length(seq)])) AS e FROM cut),
frag AS MATERIALIZED (SELECT seq_id, grp, replica::INTEGER AS replica, (row_number() OVER (PARTITION BY seq_id, replica ORDER BY b) - 1)::INTEGER AS pos, b::INTEGER AS start, substr(seq, b + 1, e - b) AS fragment FROM pieces WHERE e > b),
prim AS MATERIALIZED (SELECT seq_id, grp, pos AS idx, fragment FROM frag WHERE replica = 0),
known AS (SELECT seq_id, fragment, max(idx) AS idx FROM prim GROUP BY ALL)"""

EDGES = FRAGS + """,
whole AS (SELECT DISTINCT seq_id, fragment FROM frag WHERE length(fragment) > 1),
halves AS (SELECT seq_id, fragment, unnest(range(1, length(fragment))) AS n FROM whole),
edges AS MATERIALIZED (SELECT DISTINCT h.seq_id, a.idx AS i, b.idx AS j FROM halves h
  JOIN known a ON a.seq_id = h.seq_id AND a.fragment = substr(h.fragment, 1, n)
  JOIN known b ON b.seq_id = h.seq_id AND b.fragment = substr(h.fragment, n + 1))"""

IMPOSSIBLE = "(right({0}, 1) NOT IN ('K', 'R') OR starts_with({1}, 'P'))"
