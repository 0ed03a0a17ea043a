"""SQL for the training-data queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS doc, {_TERMS.format("coalesce(text, '')")} AS words FROM documents
),
corpus AS (SELECT count(*) AS n_docs, sum(len(words)) AS n_all FROM docs WHERE len(words) > 0),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL
),
held AS (
  SELECT doc, doc_id, n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, len(words) AS n, unnest(words) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, corpus GROUP BY term, n_docs
),
scored AS (
  SELECT item_id, doc, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term), corpus GROUP BY ALL
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _levels(name: str, source: str) -> str:
    """Digests of all nodes above those of ``source`` (grp, r, n, h), two children each."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, r, n, h FROM {source}
  UNION ALL
  SELECT grp, lvl + 1, r // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY r)) FROM {name} WHERE n > 1 GROUP BY grp, lvl, r // 2, n
)"""


def _climb(name: str, start: str, nodes: str) -> str:
    """The digest and the siblings collected on the way up from ``start`` (row, grp, r, n, acc, proof)."""
    return f"""{name} AS (
  SELECT row, grp, 0 AS lvl, r, n, acc, proof FROM {start}
  UNION ALL
  SELECT w.row, w.grp, w.lvl + 1, w.r // 2, (w.n + 1) // 2,
    sha256(CASE WHEN s.h IS NULL THEN w.acc WHEN w.r % 2 = 0 THEN w.acc || s.h ELSE s.h || w.acc END), w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.grp = w.grp AND s.lvl = w.lvl AND s.r = xor(w.r, 1) WHERE w.n > 1
)"""


MANIFEST = f"""
WITH RECURSIVE
crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce(
    [c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
),
rows AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, row_number() OVER () AS row,
    CASE WHEN xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]))) % 7 = 0
    THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents, crc
),
leaves AS (
  SELECT *, coalesce('=' || lang, '') AS grp, leaf AS h, coalesce(changed, leaf) AS acc, '' AS proof,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM rows
),
{_levels("nodes", "leaves")},
tops AS (
  SELECT '' AS grp, grp AS name, h, row_number() OVER (ORDER BY grp) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1
),
{_levels("upper", "tops")},
{_climb("lower_walk", "leaves", "nodes")},
started AS (
  SELECT w.row, t.grp, t.r, t.n, w.acc, w.proof, t.h AS subroot FROM lower_walk w JOIN tops t ON t.name = w.grp WHERE w.n = 1
),
{_climb("upper_walk", "started", "upper")}
SELECT l.doc_id, l.leaf, s.subroot, u.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = u.h AS verified
FROM leaves l JOIN started s USING (row) JOIN (SELECT * FROM upper_walk WHERE n = 1) w USING (row),
  (SELECT h FROM upper WHERE n = 1) u
"""
