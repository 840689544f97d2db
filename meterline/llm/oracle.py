"""SQL twins of the text queries that SQL can express."""

from __future__ import annotations

from meterline.llm.common import LOWER, UPPER


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = (
        "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), "
        "lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    )
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), items AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS pos
  FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win FROM items
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size
), found AS (
  SELECT p.rid, p.pos, p.size, x.item_id
  FROM (SELECT rid, pos, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win FROM places) p
  JOIN windows x ON x.size = p.size AND x.win = p.win
), hits AS (
  SELECT rid, count(*) AS n_hit FROM (
    SELECT DISTINCT rid, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), h AS (
  SELECT *, CAST(len(tok) AS BIGINT) AS n,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(list_slice(tok, 1, i), '') AS pre, array_to_string(list_slice(tok, i + 1, j), '') AS mid,
    array_to_string(list_slice(tok, j + 1, n), '') AS suf
  FROM f
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _climb(name: str, start: str, runs: str) -> str:
    """Recursion from nodes to their root: what they hash to, and the siblings on the way."""
    low, high = "array_to_string(hs[1:k], '')", "array_to_string(hs[k + 2:8], '')"
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT rid, grp, lev + 1, idx // 8, (n + 7) // 8, sha256({low} || cur || {high}), proof || {low} || {high}
  FROM (SELECT c.*, r.hs, c.idx % 8 AS k FROM {name} c
    JOIN {runs} r ON r.grp = c.grp AND r.lev = c.lev AND r.par = c.idx // 8 WHERE c.n > 1)
)"""


OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('.' || lang, '-') AS grp, {_leaf("text")} AS h,
    CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_leaf(_lower("text"))} END AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
    count(*) OVER (PARTITION BY grp) AS n
  FROM leaves
), nodes AS (
  SELECT 0 AS lev, grp, idx, n, h FROM placed
  UNION ALL
  SELECT lev + 1, grp, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lev, grp, idx // 8
), subroots AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lev, '' AS grp, idx, n, h FROM subroots
  UNION ALL
  SELECT lev + 1, '', idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM tops WHERE n > 1 GROUP BY lev, idx // 8
), runs AS (SELECT grp, lev, idx // 8 AS par, list(h ORDER BY idx) AS hs FROM nodes GROUP BY grp, lev, idx // 8),
top_runs AS (SELECT grp, lev, idx // 8 AS par, list(h ORDER BY idx) AS hs FROM tops GROUP BY grp, lev, idx // 8),
{_climb("lower_part", "SELECT rid, grp, 0 AS lev, idx, n, coalesce(tampered, h) AS cur, '' AS proof FROM placed", "runs")},
{_climb("upper_part", "SELECT l.rid, '' AS grp, 0 AS lev, s.idx, s.n, l.cur, l.proof FROM lower_part l JOIN subroots s ON s.grp = l.grp WHERE l.n = 1", "top_runs")}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(u.proof) AS proof_sha256,
  u.cur AS folded_root, u.cur = t.h AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp
JOIN upper_part u ON u.rid = p.rid AND u.n = 1
JOIN (SELECT h FROM tops WHERE n = 1) t ON true
"""

ORACLE_SQL: dict[str, str] = {
    "op5_benchmark_decontamination": OP5,
    "op11_fill_in_middle": OP11,
    "op12_merkle_manifest": OP12,
}
