"""Equivalent SQL for those queries that SQL can express."""

from __future__ import annotations


def _token(c: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '[\s-]+', '_', 'g'), '')"


def _id(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


_TRAIN = f"""SELECT {_id("instruction_id")} AS id, {_token("task_family")} AS f, {_token("metadata.condition")} AS c,
       {_token("metadata.category")} AS k, delivered_at
FROM instructions WHERE {_token("dataset_split")} IN ('train', 'training', 'trn', 'tr')"""

P1_FOUND = f"""
WITH r AS (SELECT DISTINCT id, f, c, k FROM ({_TRAIN}) WHERE id IS NOT NULL),
t AS (SELECT s.target_id, {_token("s.task_family")} AS f, {_token("s.condition")} AS c, {_token("s.category")} AS k,
             greatest(s.target_share * u.train_limit, s.min_count) AS need
      FROM selection_targets s JOIN train_runs u ON s.run_id = u.run_id)
SELECT t.target_id
FROM t LEFT JOIN r ON (t.f IS NULL OR t.f = r.f) AND (t.c IS NULL OR t.c = r.c) AND (t.k IS NULL OR t.k = r.k)
GROUP BY t.target_id, t.need HAVING t.need > count(DISTINCT r.id)
"""

P2_SAMPLES = f"""
WITH snaps AS (SELECT snapshot_no, until_at, row_number() OVER (ORDER BY until_at, snapshot_no) - 1 AS cohort FROM pool_snapshots),
seen AS (SELECT id, min(delivered_at) AS first_at FROM ({_TRAIN}) WHERE id IS NOT NULL AND delivered_at IS NOT NULL GROUP BY id),
store AS (SELECT id, ('0x' || substr(sha256(id), 1, 13))::BIGINT AS number, min(cohort) AS cohort
          FROM seen JOIN snaps ON first_at <= until_at GROUP BY id),
runs AS (SELECT run_id, train_limit, ('0x' || substr(sha256(CAST(coalesce(subset_seed, 0) AS VARCHAR) || ':start'), 1, 13))::BIGINT AS start_at FROM train_runs),
ranked AS (
  SELECT u.run_id, u.train_limit, s.id, s.cohort, row_number() OVER (PARTITION BY u.run_id ORDER BY s.cohort, (s.number - u.start_at + 4503599627370496) % 4503599627370496, s.id) AS r
  FROM store s CROSS JOIN runs u)
SELECT r.run_id, p.snapshot_no, r.id AS instruction_id
FROM ranked r JOIN snaps p ON p.cohort >= r.cohort
WHERE r.train_limit IS NULL OR r.r <= r.train_limit
"""

SQL: dict[str, str] = {"p1_found": P1_FOUND, "p2_samples": P2_SAMPLES, "p2_kept_store": P2_SAMPLES}
