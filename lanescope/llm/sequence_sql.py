"""DuckDB SQL for the conversation operators: the same results, stated as joins and recursion over whole sequences."""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression (reflected polynomial, a fixed value: 0xEDB88320)."""
    octets = f"list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda a, b: {bits}), 4294967295)"


_KEY = "substring(sha256(concat(strlen(role), ':', role, text)), 1, 32)"
_BLANK = r"[^\x20\x09-\x0D]"

OP13 = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_KEY}) AS k FROM said),
ids AS (SELECT conv_id, CAST({crc32('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM said)),
rebuilt AS (
  SELECT ids.conv_id, 0 AS own, k, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id - ids.conv_id % 20 AND k <= h
  UNION ALL SELECT ids.conv_id, 1, k, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND k > h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth, {_KEY} AS turn_key,
                  len(regexp_extract_all(text, '{_BLANK}+')) AS words FROM rebuilt),
path AS (
  SELECT conv_id, depth, words, string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS p FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
last AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
node AS (SELECT p, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM path GROUP BY p),
family AS (SELECT node.p, up.p AS up, up.conv_id AS parent_conv_id FROM node JOIN node up ON node.depth > 0 AND up.p = substring(node.p, 1, length(node.p) - 32)),
brood AS (SELECT up AS p, count(*) AS n FROM family GROUP BY up),
under AS (SELECT DISTINCT a.p AS top, b.p AS p FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
tree AS (SELECT top, count(*) FILTER (WHERE brood.n IS NULL) AS n_leaves, sum(saved) AS saved_tokens
         FROM under JOIN node ON node.p = under.p LEFT JOIN brood ON brood.p = under.p GROUP BY top),
ends AS (SELECT p, string_agg(CAST(path.conv_id AS VARCHAR), ',' ORDER BY path.conv_id) AS said
         FROM path JOIN last ON last.conv_id = path.conv_id AND last.depth = path.depth GROUP BY p)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(brood.n, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(said, '')) AS ends_sha256
FROM node JOIN tree ON tree.top = node.p LEFT JOIN family ON family.p = node.p LEFT JOIN brood ON brood.p = node.p LEFT JOIN ends ON ends.p = node.p
"""

#: Role state after a turn that may choose its role, by state (start, system, user, assistant).
_NEXT = "CASE {} WHEN 2 THEN 3 ELSE 2 END"
_TO = "CASE {} WHEN 2 THEN 'assistant' ELSE 'user' END"


def _inserted(rows: str) -> str:
    """Rows (conv_id, i, q, cost, audit, lines) and what up to two insertions make of them, the best for each state."""
    once = f"SELECT conv_id, i, {_NEXT.format('q')} AS q, cost + 3 AS cost, audit || 'I' AS audit, lines || [{_TO.format('q')} || ':'] AS lines FROM"
    return f"""
  SELECT conv_id, i, q, best.cost AS cost, best.audit AS audit, best.lines AS lines FROM (
    SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
      SELECT conv_id, i, q, cost, audit, lines FROM ({rows})
      UNION ALL {once} ({rows})
      UNION ALL {once} ({once} ({rows}))) GROUP BY conv_id, i, q)"""


_EDITED = f"""
    SELECT w.conv_id, f.i, w.q, w.cost + 4 AS cost, w.audit || 'D' AS audit, w.lines FROM ways w JOIN faulty f ON f.conv_id = w.conv_id AND f.i = w.i + 1
    UNION ALL
    SELECT w.conv_id, f.i, {_NEXT.format('w.q')}, w.cost + 3 + 3 * CAST(fault = 't' AS INTEGER), w.audit || 'R', w.lines || [{_TO.format('w.q')} || ':' || f.text]
    FROM ways w JOIN faulty f ON f.conv_id = w.conv_id AND f.i = w.i + 1 WHERE fault NOT IN ('b', 'd')
    UNION ALL
    SELECT w.conv_id, f.i, CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, w.cost + 3 * CAST(fault = 't' AS INTEGER), w.audit || 'K',
           w.lines || [f.role || ':' || f.text]
    FROM ways w JOIN faulty f ON f.conv_id = w.conv_id AND f.i = w.i + 1
    WHERE fault NOT IN ('b', 'd') AND (w.q || initial) IN ('0s', '0u', '1u', '2a', '3u')"""

#: Conversations with a null id do not occur in the given tables and are left out of the comparison.
OP11 = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("concat(conv_id, ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations WHERE conv_id IS NOT NULL),
damaged AS (
  SELECT conv_id, turn, if(kind = 4, 'user', role) AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM said WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM said WHERE kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {_KEY}) AS i, substring(role, 1, 1) AS initial,
                  regexp_extract(text, '({_BLANK})[\\x20\\x09-\\x0D]*$', 1) AS final FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{_BLANK}') THEN 'b'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                          WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
tally AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faulty GROUP BY conv_id),
ways AS ({_inserted("SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM tally")}
  UNION ALL {_inserted(_EDITED)}),
done AS (SELECT w.conv_id, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best
         FROM ways w JOIN tally ON tally.conv_id = w.conv_id AND w.i = tally.n WHERE q IN (0, 3) GROUP BY w.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN tally ON tally.conv_id = ids.conv_id LEFT JOIN done ON done.conv_id = ids.conv_id
"""
