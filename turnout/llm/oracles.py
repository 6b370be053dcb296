"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from turnout.llm import mixing
from turnout.llm.queries import HARD_TEXT

_CHANCE = (
    f"CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || "
    "coalesce(source, '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT) / 4503599627370496.0"
)

OP1 = f"""
WITH docs AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM docs GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3] AS BIGINT) AS w
  FROM totals),
ranked AS (
  SELECT *, 3 * s / w AS full_at,
    coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 3 * s / w DESC, w DESC, s DESC ROWS UNBOUNDED PRECEDING) AS open_w
  FROM weighted),
levels AS (
  SELECT *, CAST((SELECT sum(s) FROM totals) - capped AS DOUBLE) / CAST(open_w AS DOUBLE) AS level FROM ranked),
found AS (
  SELECT coalesce((SELECT level FROM levels WHERE full_at > level ORDER BY full_at, w, s LIMIT 1),
                  (SELECT max(full_at) FROM levels)) AS level),
targets AS (
  SELECT source, s, least(CAST(3 * s AS DOUBLE), w * level) AS target FROM weighted, found),
rates AS (
  SELECT d.*, s AS source_size, target, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copied AS (
  SELECT *, CAST(floor(rate) + CASE WHEN {_CHANCE} < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM rates)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""


def _spans(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches with their gaps: a match starts where the gaps and matches before it end."""
    return f"""
  SELECT id, {kind} AS kind, CAST(ends - size AS BIGINT) AS s, CAST(ends AS BIGINT) AS e FROM (
    SELECT id, length(m) AS size, length(v) AS value, sum(length(gap) + length(m)) OVER (PARTITION BY id ORDER BY k) AS ends FROM (
      SELECT id, unnest(found) AS m, unnest(vals) AS v, unnest(gaps[1:len(found)]) AS gap, unnest(range(len(found))) AS k FROM (
        SELECT id, string_split_regex(body, '{pattern}') AS gaps,
          regexp_extract_all(body, '{pattern}') AS found,
          regexp_extract_all(body, '{pattern}', {group}) AS vals
        FROM docs WHERE regexp_matches(body, '{pattern}')))) WHERE value >= {least}"""


_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
    "[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)

_ACCESS, _HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"

OP2 = f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({_spans(0, _ASSIGN, 2, 6)}
  UNION ALL {_spans(1, _ACCESS, 0, 20)}
  UNION ALL {_spans(2, _HEX, 0, 24)}),
listed AS (
  SELECT id, CAST(count(*) FILTER (kind = 0) AS BIGINT) AS n_assign,
    CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (id)
"""

OP7 = """
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM docs)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM best
"""

OP10 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'),
ordered AS (
  SELECT *, row_number() OVER w AS k,
    lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS same
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(text) + 1 * (length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '>', ''))) AS body,
    CASE WHEN same THEN 6 ELSE 7 + length(role)
      + (length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), '>', ''))) + 8 END AS marks
  FROM ordered)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: a reduction over its characters of one over 8 shifts."""
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
    )


# The edits of op11 walk along the rows: the four best strings that reach each state of (s?(ua)+)?, as
# cost and audit in one text, so that the least text is the cheapest, ASCII-least way.
def _way(state: str, cost: str, edit: str) -> str:
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{edit}'"


def _inserted(c: dict[int, str]) -> dict[int, str]:
    """After up to two rows put in: a user row after states 0, 1 and 3, an assistant row after 2."""
    once = {0: c[0], 1: c[1], 2: f"least({c[2]}, {', '.join(_way(c[p], '3', 'I') for p in (0, 1, 3))})", 3: f"least({c[3]}, {_way(c[2], '3', 'I')})"}
    return once | {3: f"least({once[3]}, {_way(c[0], '6', 'II')}, {_way(c[1], '6', 'II')})"}


def _step() -> str:
    i = {k: f"i{k}" for k in range(4)}

    def after(q: int, sources: tuple[int, ...], initial: str, rerole: bool) -> str:
        ways = [_way(i[q], "4", "D")]
        for p in sources:
            keep = _way(i[p], "extra", "K")
            ways.append(f"CASE WHEN stays AND initial = '{initial}' THEN {keep} END")
            if rerole:
                ways.append(f"CASE WHEN stays THEN {_way(i[p], '3 + extra', 'R')} END")
        return f"least({', '.join(ways)}) AS c{q}"

    return ", ".join(
        (after(0, (), "", False), after(1, (0,), "s", False), after(2, (0, 1, 3), "u", True), after(3, (2,), "a", True))
    )


_NEVER = "'900000000'"
_STATES = {k: f"c{k}" for k in range(4)}
_INSERTED = ", ".join(f"{v} AS i{k}" for k, v in _inserted(_STATES).items())

OP11 = f"""
WITH RECURSIVE rows_ AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM rows_, range(2) AS t(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS k
  FROM hurt),
faulty AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault
  FROM placed),
edited AS (
  SELECT conv_id, k, initial, fault IN ('none', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra
  FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, 0 AS k, '000000000' AS c0, {_NEVER} AS c1, {_NEVER} AS c2, {_NEVER} AS c3 FROM counts
  UNION ALL
  SELECT conv_id, n, k, {_step()} FROM (
    SELECT w.conv_id, w.n, e.k, e.initial, e.stays, e.extra, {_INSERTED}
    FROM walk w JOIN edited e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k + 1)),
ended AS (
  SELECT conv_id, least(i0, i3) AS best FROM (SELECT conv_id, {_INSERTED} FROM walk WHERE k = n)),
plans AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended),
letters AS (
  SELECT conv_id, nth, substr(audit, nth, 1) AS edit, len(replace(substr(audit, 1, nth), 'I', '')) AS k,
    len(replace(substr(audit, 1, nth), 'D', '')) AS place
  FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS nth FROM plans)),
repaired AS (
  SELECT l.conv_id, l.place, l.edit, f.role, CASE WHEN l.edit = 'I' THEN '' ELSE f.text END AS text,
    coalesce(bool_or(l.edit = 'K' AND f.initial = 's') OVER (PARTITION BY l.conv_id), false) AS shifted
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND l.edit <> 'I' AND f.k = l.k
  WHERE l.edit <> 'D'),
digests AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (place + CAST(shifted AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY place)) AS repaired_sha256
  FROM repaired GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plans ON plans.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN digests ON digests.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12 = f"""
WITH turns AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, t.k, 0 AS part, id, chars FROM convs c JOIN turns t ON t.conv_id = base AND t.k <= h
  UNION ALL SELECT c.conv_id, t.k, 1, id, chars FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > h),
built AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d, id, chars FROM parts),
prefixes AS (
  SELECT conv_id, 0 AS d, [] AS path, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, d, list(id) OVER (PARTITION BY conv_id ORDER BY d) AS path, chars FROM built),
sizes AS (SELECT conv_id, max(d) AS size FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM prefixes JOIN sizes USING (conv_id) GROUP BY path, d),
children AS (SELECT path[:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.path = children.path),
upward AS (SELECT path[:unnest(range(0, d + 1))] AS path, n_children, (n_convs - 1) * chars AS saved FROM whole),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM upward GROUP BY path)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN sums ON sums.path = w.path LEFT JOIN whole p ON w.d > 0 AND p.path = w.path[:w.d - 1]
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_secrets": OP2, "op7_exact_dedup": OP7, "op10_chat": OP10, "op11_repair": OP11, "op12_prefix_trie": OP12}
