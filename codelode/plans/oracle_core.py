"""The same questions in SQL for the core problems 1, 2 and 6."""

_COMMITS = r"""
c AS (SELECT repository_id, regexp_replace(lower(commit_hash), '\s+', '', 'g') AS h, created_at, committed_at, parent_hashes
      FROM commits WHERE repository_id IS NOT NULL AND commit_hash IS NOT NULL AND trim(commit_hash) <> ''),
g AS (SELECT repository_id, regexp_replace(lower(commit_hash), '\s+', '', 'g') AS h, max(deleted_at) AS deleted_at
      FROM deleted_commits GROUP BY 1, 2),
s AS (SELECT c.repository_id, c.h, min(c.created_at) AS first_arrival, min(c.committed_at) AS committed_at,
             NOT (any_value(g.deleted_at) IS NOT NULL AND (max(c.created_at) IS NULL OR any_value(g.deleted_at) >= max(c.created_at))) AS live
      FROM c LEFT JOIN g ON g.repository_id = c.repository_id AND g.h = c.h GROUP BY 1, 2),
n AS (SELECT DISTINCT repository_id, h, unnest(regexp_extract_all(lower(parent_hashes), '[0-9a-f]+')) AS p FROM c),
r AS (SELECT n.*, s.first_arrival, s.committed_at FROM n JOIN s ON s.repository_id = n.repository_id AND s.h = n.h AND s.live
      WHERE length(p) BETWEEN 7 AND 40 AND p <> repeat('0', 40))"""

_RUNS = r"""
ok AS (SELECT id, min(repository_id) AS repository_id, min(started_at) AS started_at FROM analysis_runs
       WHERE status IN ('completed', 'completed_with_warnings') AND repository_id IS NOT NULL AND started_at IS NOT NULL GROUP BY 1),
runs AS (SELECT id, repository_id, lag(id) OVER (PARTITION BY repository_id ORDER BY started_at, id) AS prev FROM ok),
f AS (SELECT id, min(regexp_replace(regexp_replace(path, '[/\\]+', '/', 'g'), '^(\./)+', '')) AS path FROM files GROUP BY 1),
k AS (SELECT s.analysis_run_id AS run, f.path, regexp_replace(s.name, '^\s+|\s+$', '', 'g') AS name,
             list_sort(list(DISTINCT {'t': s.symbol_type, 'n': s.end_line - s.start_line + 1})) AS v
      FROM symbols s JOIN f ON f.id = s.file_id WHERE s.name IS NOT NULL GROUP BY 1, 2, 3),
pairs AS (SELECT * FROM runs WHERE prev IS NOT NULL),
b AS (SELECT p.repository_id, p.id, k.path, k.name, k.v FROM pairs p JOIN k ON k.run = p.id),
a AS (SELECT p.repository_id, p.id, k.path, k.name, k.v FROM pairs p JOIN k ON k.run = p.prev)"""

_TREE = r"""
n AS (SELECT id, min(parent_symbol_id) AS p0, coalesce(min(coalesce(name, '')), '') AS name FROM symbols WHERE id IS NOT NULL GROUP BY 1),
l AS (SELECT n.id, n.name, m.id AS p FROM n LEFT JOIN n m ON m.id = n.p0),
t AS (SELECT id, name AS path, 0 AS depth, id AS root_id, [id] AS ids FROM l WHERE p IS NULL
      UNION ALL SELECT l.id, t.path || '/' || l.name, t.depth + 1, t.root_id, list_append(t.ids, l.id) FROM l JOIN t ON l.p = t.id)"""

#: Endless chains are short here, so walking as many steps as there are endless nodes is cheap.
_LOOP = r"""
e AS (SELECT id, p FROM l WHERE id NOT IN (SELECT id FROM t)),
w AS (SELECT id, id AS at, [id] AS seen FROM e
      UNION ALL SELECT w.id, e.p, list_append(w.seen, e.p) FROM w JOIN e ON e.id = w.at WHERE NOT list_contains(w.seen, e.p)),
z AS (SELECT w.id, w.seen, e.p FROM w JOIN e ON e.id = w.at WHERE list_contains(w.seen, e.p))"""

SQL = {
    "p1_found": f"""WITH {_COMMITS}
SELECT DISTINCT r.repository_id, r.h AS commit_hash, r.p AS parent_hash FROM r
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.live AND s.repository_id = r.repository_id
                  AND left(s.h, 7) = left(r.p, 7) AND starts_with(s.h, r.p))""",
    "p1_orphan_counts": f"""WITH {_COMMITS},
m AS (SELECT r.repository_id, r.h, r.p, any_value(r.first_arrival) AS first_arrival, any_value(r.committed_at) AS committed_at,
             count(*) FILTER (WHERE s.live) AS n_live, count(*) FILTER (WHERE NOT s.live) AS n_dead,
             min(s.first_arrival) FILTER (WHERE s.live) AS parent_arrival
      FROM r LEFT JOIN s ON s.repository_id = r.repository_id AND left(s.h, 7) = left(r.p, 7) AND starts_with(s.h, r.p)
      GROUP BY 1, 2, 3)
SELECT 'commits' AS table_name, repository_id, strftime(committed_at, '%Y-%m') AS month, count(*)::BIGINT AS n_references,
       count(*) FILTER (WHERE n_live = 0 AND n_dead = 0)::BIGINT AS n_missing,
       count(*) FILTER (WHERE n_live = 0 AND n_dead > 0)::BIGINT AS n_deleted,
       count(*) FILTER (WHERE parent_arrival > first_arrival)::BIGINT AS n_late
FROM m GROUP BY 1, 2, 3""",
    "p2_found": f"""WITH {_RUNS}
SELECT repository_id, id AS analysis_run_id, path, name,
       CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM b FULL JOIN a USING (repository_id, id, path, name)
WHERE a.v IS NULL OR b.v IS NULL OR a.v IS DISTINCT FROM b.v""",
    "p6_found": f"""WITH RECURSIVE {_TREE}, {_LOOP}
SELECT z.id AS symbol_id, list_min(list_slice(z.seen, list_position(z.seen, z.p), len(z.seen))) AS cycle_id FROM z""",
    "p6_hierarchy": f"""WITH RECURSIVE {_TREE}, {_LOOP},
d AS (SELECT id, count(*) AS n FROM (SELECT unnest(ids[1:len(ids) - 1]) AS id FROM t) GROUP BY 1)
SELECT t.id AS symbol_id, t.path, t.depth::INTEGER AS depth, t.root_id, coalesce(d.n, 0)::BIGINT AS n_descendants, NULL::VARCHAR AS cycle_id
FROM t LEFT JOIN d ON d.id = t.id
UNION ALL
SELECT z.id, NULL, NULL, NULL, NULL, list_min(list_slice(z.seen, list_position(z.seen, z.p), len(z.seen))) FROM z""",
    "p6_descendants": f"""WITH RECURSIVE {_TREE}
SELECT ids[i] AS ancestor_id, id AS descendant_id, (len(ids) - i)::INTEGER AS distance
FROM (SELECT id, ids, unnest(generate_series(1, len(ids) - 1)) AS i FROM t)""",
}
