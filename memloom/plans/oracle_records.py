"""DuckDB statements for the change-feed, reference and history queries, written independently."""

WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

CHANGES = rf"""
 raw AS (
  SELECT lower(trim(memory_id)) AS m, id, upper(trim(action)) AS a, new_value, previous_value,
         coalesce(epoch_us(updated_at::TIMESTAMPTZ), epoch_us(created_at::TIMESTAMPTZ), CASE WHEN upper(trim(action)) = 'DELETE' THEN 9223372036854775807 ELSE epoch_us(ingested_at) END) AS ts
  FROM memory_history WHERE trim(memory_id) <> ''),
 dedup AS (
  SELECT * FROM raw WHERE a IN ('ADD', 'UPDATE', 'DELETE')
   AND (a = 'DELETE' OR coalesce(regexp_replace(new_value, '{WS}', '', 'g'), '') <> '')
  QUALIFY row_number() OVER (PARTITION BY m, a, new_value, ts ORDER BY id) = 1),
 marked AS (
  SELECT *, last_value(CASE WHEN a <> 'UPDATE' THEN a END IGNORE NULLS)
    OVER (PARTITION BY m ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la
  FROM dedup),
 eff AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY ts, id) AS pos FROM marked WHERE a <> 'UPDATE' OR la IS NULL OR la = 'ADD')
"""

CURRENT = f"""
WITH {CHANGES}
SELECT m AS memory_id, id AS history_id FROM eff
QUALIFY row_number() OVER (PARTITION BY m ORDER BY pos DESC) = 1 AND a <> 'DELETE'
"""

CURRENT_ROWS = f"""
WITH {CHANGES}
SELECT m AS memory_id, id AS history_id, new_value AS text FROM eff
QUALIFY row_number() OVER (PARTITION BY m ORDER BY pos DESC) = 1 AND a <> 'DELETE'
"""

ORPHANS = """
WITH refs AS (
  SELECT 'fact.source_ids' AS f, 'messages' AS t, lower(trim(id)) AS r, lower(trim(x)) AS k, min(ingested_at) OVER (PARTITION BY lower(trim(id))) AS arr
  FROM (SELECT id, ingested_at, unnest(source_ids) AS x FROM facts)
  UNION SELECT 'fact.supersedes', 'facts', lower(trim(id)), lower(trim(x)), min(ingested_at) OVER (PARTITION BY lower(trim(id)))
  FROM (SELECT id, ingested_at, unnest(supersedes) AS x FROM facts)
  UNION SELECT 'memory_history.memory_id', 'memories', id::VARCHAR, lower(trim(memory_id)), ingested_at FROM memory_history),
 targets AS (
  SELECT 'messages' AS t, lower(trim(id)) AS k, min(ingested_at) AS seen, arg_max(coalesce(redacted, false), ingested_at) AS gone, NULL::TIMESTAMP AS purged FROM messages GROUP BY ALL
  UNION ALL SELECT 'facts', lower(trim(id)), min(ingested_at), arg_max(coalesce(lower(state) = 'erased', false), ingested_at), NULL FROM facts GROUP BY ALL
  UNION ALL SELECT 'memories', lower(trim(id)), min(ingested_at), false, min(purged_at) FROM memories GROUP BY ALL),
 found AS (
  SELECT f, r, k, arr, CASE WHEN seen IS NULL THEN 'absent' WHEN gone OR coalesce(purged <= arr, false) THEN 'removed' WHEN seen > arr THEN 'late' END AS reason
  FROM refs LEFT JOIN targets USING (t, k) WHERE k <> '')
"""

VERSIONS = f"""
WITH {CHANGES},
 steps AS (
  SELECT m, pos, id::VARCHAR AS id, a, CASE WHEN a = 'DELETE' THEN NULL ELSE trim(regexp_replace(new_value, '{WS}', ' ', 'g')) END AS v FROM eff
  UNION ALL SELECT m, 0, '', 'ADD', chr(1) FROM eff WHERE pos = 1 AND a <> 'ADD' AND coalesce(regexp_replace(previous_value, '{WS}', '', 'g'), '') <> ''),
 bounds AS (SELECT *, lag(v) OVER w AS pv, row_number() OVER w AS rn FROM steps WINDOW w AS (PARTITION BY m ORDER BY pos)),
 runs AS (SELECT *, coalesce(lead(id) OVER (PARTITION BY m ORDER BY pos), '') AS nxt FROM bounds WHERE rn = 1 OR v IS DISTINCT FROM pv),
 f AS (SELECT DISTINCT lower(trim(id)) AS id, observed_at::TIMESTAMPTZ AS o, supersedes FROM facts WHERE observed_at IS NOT NULL),
 pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b, b.o FROM (SELECT id, o, lower(trim(unnest(supersedes))) AS k FROM f) b JOIN f a ON a.id = b.k WHERE a.id <> b.id AND a.o < b.o),
 fv AS (SELECT a AS opened_by, first(b ORDER BY o, b) AS closed_by FROM pairs GROUP BY a)
SELECT 'memory_history' AS source_table, id AS opened_by, nxt AS closed_by FROM runs WHERE a <> 'DELETE'
UNION SELECT 'facts', opened_by, closed_by FROM fv
UNION SELECT 'facts', b, '' FROM pairs WHERE b NOT IN (SELECT opened_by FROM fv)
"""

SQL = {
    "p2_found": CURRENT,
    "p2_incremental": CURRENT,
    "p2_current_memories": CURRENT_ROWS,
    "p3_found": ORPHANS + "SELECT f AS ref_field, r AS record_id, k AS ref_key FROM found WHERE reason IS NOT NULL",
    "p3_orphans_per_month": ORPHANS
    + "SELECT f AS ref_field, reason, strftime(arr, '%Y-%m') AS month, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": VERSIONS,
}
