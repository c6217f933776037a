"""DuckDB statements for the queries that SQL can express, written independently."""

WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

CONVERSATIONS = rf"""
WITH v AS (
  SELECT * FROM messages WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1),
 w AS (
  SELECT id, session_id, ordinal, ingested_at, lower(trim(coalesce(role, json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.role')))) AS alias,
         coalesce(content, json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.content')) AS text FROM v),
 x AS (
  SELECT w.*, a.speaker, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t,
         coalesce(regexp_replace(text, '({WS}|[\p{{Cc}}\p{{Cf}}])+', '', 'g') <> '', false) AS visible
  FROM w LEFT JOIN (SELECT DISTINCT lower(trim(alias)) AS alias, speaker FROM role_aliases) a USING (alias)),
 turn AS (
  SELECT session_id, ordinal, min(speaker) AS speaker, bool_or(speaker IS NULL) AS stranger, arg_min(text, (ingested_at, id)) AS text,
         count(DISTINCT (coalesce(speaker, '?'), coalesce('.' || t, ''))) > 1 AS conflict,
         bool_or(NOT visible AND coalesce(speaker, '?') IN ('user', 'assistant')) AS blank
  FROM x GROUP BY ALL),
 bad AS (
  SELECT session_id FROM turn GROUP BY ALL
  HAVING count(*) <> max(ordinal) + 1 OR min(ordinal) <> 0 OR bool_or(conflict) OR bool_or(stranger) OR bool_or(blank)
   OR NOT bool_or(coalesce(speaker = 'user', false)) OR NOT bool_or(coalesce(speaker = 'assistant', false))
   OR arg_max(speaker, ordinal) FILTER (speaker IN ('user', 'assistant')) = 'user')
"""

SQL = {
    "p1_found": CONVERSATIONS + "SELECT session_id FROM bad",
    "p1_conversations": CONVERSATIONS + "SELECT session_id, ordinal AS turn, speaker, text FROM turn WHERE session_id NOT IN (SELECT session_id FROM bad)",
}
