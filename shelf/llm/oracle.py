"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, k: int) -> str:
    """Distinct word shingles ``(key, s)`` of a table."""
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS s FROM
      (SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM
        (SELECT {key}, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0))"""


def _closure(links: str) -> str:
    """Components ``cc(node, c)`` of a table of links ``(a, b)``, by their least node."""
    return f"""ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
      reach AS (SELECT a AS node, a AS c FROM ways UNION SELECT r.node, e.b FROM reach r JOIN ways e ON r.c = e.a),
      cc AS (SELECT node, min(c) AS c FROM reach GROUP BY node)"""


NEAR_DUPLICATES = f"""WITH RECURSIVE s AS MATERIALIZED {_shingles('documents', 'doc_id', 3)},
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
  {_closure('l')}
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(cc.c, d.doc_id) AS component_id, coalesce(cc.c, d.doc_id) = d.doc_id AS kept
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN cc ON cc.node = d.doc_id"""

DUPLICATE_LINES = f"""WITH RECURSIVE f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
  t AS MATERIALIZED (SELECT doc_id, CAST(no AS INT) AS no, doc_id * 16777216 + no AS oid, line FROM f WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
  u AS MATERIALIZED (SELECT line, min(oid) AS rep FROM t GROUP BY 1),
  s AS MATERIALIZED (SELECT DISTINCT rep, substring(line, i, 8) AS s FROM (SELECT rep, line, unnest(range(1, greatest(length(line) - 7, 1) + 1)) AS i FROM u)),
  n AS MATERIALIZED (SELECT rep, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
  {_closure('l')}
  SELECT t.doc_id, t.no AS line_no, coalesce(cc.c, u.rep) // 16777216 AS kept_doc_id, CAST(coalesce(cc.c, u.rep) % 16777216 AS INT) AS kept_line_no
  FROM t JOIN u USING (line) LEFT JOIN cc ON cc.node = u.rep WHERE t.oid <> coalesce(cc.c, u.rep)"""

CONTAMINATED = f"""WITH d AS {_shingles('documents', 'doc_id', 5)}, i AS MATERIALIZED {_shingles('benchmark', 'item_id', 5)},
  n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
  p AS (SELECT doc_id, item_id, count(*) AS m FROM d JOIN i USING (s) GROUP BY 1, 2)
  SELECT doc_id, item_id, m AS shared, n AS item_shingles, m / n AS containment FROM p JOIN n USING (item_id) WHERE m / n >= 0.8"""

ORACLE_SQL = {"op3_neardup": NEAR_DUPLICATES, "op5_lines": DUPLICATE_LINES, "op7_decontam": CONTAMINATED}
