"""Queries of the engine's operators over the tables of a folder, each beside its SQL.

Every query runs over all rows of its tables; a literal in a call is the
parameter that the operator takes (a path, a commit, a search text, a date).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import predicates as P
from codelode.functions import text as X
from codelode.operators import change, coverage, graph, history, ordering, runs, search, targets, testresults
from codelode.plans import adapters as A
from codelode.plans.adapters import CTE
from codelode.sources import repository
from codelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PATH = "src/brand#1/economy.py"
AFTER, UNTIL = "1997-01-01 00:00:00", "1998-01-01 00:00:00"
AS_OF = "2025-01-01 00:00:00"
TODAY = "2024-01-30 00:00:00"
SEED = 1
WORDS = "the parser layer"


def query(sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query with its SQL, after the common table expressions it names."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(CTE[c] for c in ctes)
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{head} " if head else "") + sql
        return f

    return add


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_BASE = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"CASE WHEN contains({_BASE}, '.') THEN lower(regexp_extract({_BASE}, '(\\.[^.]*)$', 1)) ELSE '' END"


def _test_sql(path: str, dirs: list[str], names: list[str]) -> str:
    base = f"list_last(string_split(lower({path}), '/'))"
    return f"(list_has_any(string_split(lower({path}), '/'), [{_in(dirs)}]) OR {_any(base, names)})"


# --- history -------------------------------------------------------------------------------------


@query(
    f"SELECT c.path, count(*)::BIGINT AS shared_commits, max(co.committed_at) AS last_changed FROM ch c JOIN co USING (commit_id) WHERE c.path <> '{PATH}' "
    f"AND c.commit_id IN (SELECT commit_id FROM ch WHERE path = '{PATH}') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "co", "ch")
def co_change(spark, folder):
    return history.co_changes(A.commits(spark, folder), A.changes(spark, folder), PATH)


@query(f"SELECT co.commit_id, repository_id, commit_hash, committed_at, path, change_type, additions, deletions FROM co JOIN ch USING (commit_id) WHERE path = '{PATH}' ORDER BY committed_at DESC, commit_id, deletions, additions LIMIT 50", "co", "ch")
def file_history(spark, folder):
    return history.file_history(A.commits(spark, folder), A.changes(spark, folder), PATH)


@query("SELECT repository_id, commit_hash, left(commit_hash, 8) AS short_hash, string_split(commit_message, chr(10))[1] AS subject, CASE WHEN contains(commit_message, chr(10)) THEN trim(regexp_replace(commit_message, '^[^\\n]*\\n', '')) ELSE '' END AS body, "
       "CASE WHEN trim(coalesce(parent_hashes, '')) = '' THEN 0 ELSE len(list_filter(string_split(parent_hashes, ','), lambda x: trim(x) <> '')) END::INTEGER AS parent_count, committed_at FROM commits")
def commit_summaries(spark, folder):
    return history.summaries(table(spark, folder, "commits"))


@query("SELECT commit_id, repository_id, commit_hash, committed_at FROM co ORDER BY committed_at DESC, commit_id LIMIT 20 OFFSET 20", "co")
def commit_page(spark, folder):
    return ordering.page(A.commits(spark, folder), F.desc("committed_at"), F.col("commit_id"), number=2)


@query("SELECT repository_id, count(*)::BIGINT AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM commits GROUP BY 1")
def commit_page_totals(spark, folder):
    return ordering.page_totals(table(spark, folder, "commits"), 20, ["repository_id"])


@query("SELECT commit_id, count(*)::BIGINT AS files_changed, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions FROM ch GROUP BY 1", "ch")
def commit_totals(spark, folder):
    return history.totals(A.changes(spark, folder))


@query("SELECT commit_id, repository_id, commit_hash, committed_at FROM co WHERE starts_with(commit_hash, '6b8') ORDER BY committed_at DESC, commit_hash, repository_id LIMIT 1", "co")
def commit_prefix_lookup(spark, folder):
    return history.by_prefix(A.commits(spark, folder), "6B8")


@query(f"SELECT repository_id, path, committed_at, commit_id, deletions, additions, change_type FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, path ORDER BY committed_at DESC, commit_id DESC, deletions DESC, additions DESC, change_type DESC) AS rn FROM co JOIN ch USING (commit_id) WHERE committed_at > '{AFTER}' AND committed_at <= '{UNTIL}') WHERE rn = 1", "co", "ch")
def range_last_change(spark, folder):
    return history.last_changes(A.commits(spark, folder), A.changes(spark, folder), AFTER, UNTIL)


@query(f"SELECT repository_id, count(DISTINCT co.commit_id)::BIGINT AS commits_in_range, count(DISTINCT path)::BIGINT AS files_changed, sum(coalesce(additions, 0))::BIGINT AS insertions, sum(coalesce(deletions, 0))::BIGINT AS deletions FROM co LEFT JOIN ch USING (commit_id) WHERE committed_at > '{AFTER}' AND committed_at <= '{UNTIL}' GROUP BY 1", "co", "ch")
def range_churn_metadata(spark, folder):
    return history.churn(A.commits(spark, folder), A.changes(spark, folder), AFTER, UNTIL)


@query("SELECT DISTINCT repository_id, commit_hash FROM commits c WHERE NOT EXISTS (SELECT 1 FROM commits o WHERE o.repository_id = c.repository_id AND o.commit_hash = c.commit_hash AND o.created_at < '2024-06-01')")
def incremental_commits(spark, folder):
    c = table(spark, folder, "commits")
    return history.new_commits(c, c.where("created_at < timestamp_ntz'2024-06-01'")).select("repository_id", "commit_hash")


# --- runs ----------------------------------------------------------------------------------------

_DONE = f"status IN ({_in(list(runs.SUCCESS))})"


@query(f"SELECT repository_id, started_at, id, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY started_at DESC, id DESC) AS rn FROM analysis_runs WHERE {_DONE} AND started_at IS NOT NULL) WHERE rn = 1")
def latest_run_per_repo(spark, folder):
    return runs.latest_run(table(spark, folder, "analysis_runs")).select("repository_id", "started_at", "id", "status")


@query("SELECT repository_id, completed_at, id, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY completed_at DESC, id DESC) AS rn FROM analysis_runs WHERE completed_at IS NOT NULL) WHERE rn = 1")
def latest_run_any_status(spark, folder):
    return runs.latest_run(table(spark, folder, "analysis_runs"), None, "completed_at").select("repository_id", "completed_at", "id", "status")


@query(f"SELECT DISTINCT id, repository_id, status, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_at)) / 3.6e9, 1) AS hours FROM analysis_runs WHERE status IN ('running', 'queued') AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_at)) / 3.6e9 > 24")
def stale_runs_report(spark, folder):
    return runs.stale_runs(table(spark, folder, "analysis_runs"), AS_OF).select("id", "repository_id", "status", "hours").distinct()


@query(f"SELECT CASE WHEN status IN ('running', 'queued') AND (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(started_at)) / 3.6e9 > 24 THEN 'failed' ELSE status END AS status, count(*)::BIGINT AS n FROM analysis_runs GROUP BY 1")
def stale_runs_recovered(spark, folder):
    return runs.recovered(table(spark, folder, "analysis_runs"), AS_OF).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- files, names and predicates -------------------------------------------------------------------


@query("SELECT repository_id, language, count(*)::BIGINT AS n_files, sum(size_bytes)::BIGINT AS size_bytes FROM files WHERE language IS NOT NULL GROUP BY 1, 2")
def language_histogram(spark, folder):
    return table(spark, folder, "files").where("language is not null").groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("size_bytes"))


@query("SELECT language, count(*)::BIGINT AS n_files FROM files WHERE language IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def top_languages(spark, folder):
    return table(spark, folder, "files").where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "language").limit(6)


_LANG = "CASE " + " ".join(f"WHEN x = '{k}' THEN '{v}'" for k, v in K.LANGUAGES.items()) + " END"


@query(f"SELECT repository_id, path, {_BASE} AS filename, x AS extension, {_LANG} AS language, strlen(content)::BIGINT AS size_bytes, "
       "CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END::INTEGER AS lines, "
       f"lower({_BASE}) IN ({_in(K.SENSITIVE_FILES)}) AS is_sensitive, sha256(content) AS content_hash FROM (SELECT *, {_EXT} AS x FROM (SELECT repository_id, replace(path, chr(92), '/') AS path, content FROM file_info))")
def file_metadata(spark, folder):
    return repository.metadata(table(spark, folder, "file_info"))


@query("SELECT DISTINCT id, path FROM files WHERE path ILIKE '%test%'")
def file_search_ilike(spark, folder):
    return table(spark, folder, "files").where(F.col("path").ilike("%test%")).select("id", "path").distinct()


@query("SELECT DISTINCT trim(name) AS name, symbol_type, language, id FROM symbols WHERE name ILIKE '%list%' AND symbol_type = 'function' AND language = 'TypeScript' ORDER BY name, id LIMIT 1000")
def symbol_filter_page(spark, folder):
    s = table(spark, folder, "symbols").where(F.col("name").ilike("%list%") & (F.col("symbol_type") == "function") & (F.col("language") == "TypeScript"))
    rows = s.select(F.trim("name").alias("name"), "symbol_type", "language", "id").distinct()
    return ordering.page(rows, F.col("name"), F.col("id"), size=1000, most=1000)


_CI_SQL = r"regexp_matches(lower(path), '\.github/workflows/.*\.ya?ml$|\.gitlab-ci\.ya?ml$|\.circleci/config\.yml$|azure-pipelines\.yml$|\.travis\.yml$|jenkinsfile|\.drone\.yml$|bitbucket-pipelines\.yml$')"


@query(f"SELECT DISTINCT path, language, {_test_sql('path', K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)} AS is_changed_test, {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)} AS is_test, {_any('lower(path)', ['test', 'spec'])} AS looks_like_test, {_CI_SQL} AS is_ci, "
       f"(coalesce(language IN ({_in(K.SOURCE_LANGUAGES)}), false) AND NOT {_any('lower(path)', K.NON_SOURCE_PATHS)}) AS is_source, {_EXT} IN ({_in(K.BINARY_EXTENSIONS)}) AS is_binary, "
       f"{_any('lower(path)', K.SECURITY_PATHS)} AS is_security, {_any('lower(path)', K.DATABASE_PATHS)} AS is_database, {_any('lower(path)', K.PAYMENT_PATHS)} AS is_payment FROM file_info")
def path_predicates(spark, folder):
    p = F.col("path")
    return table(spark, folder, "file_info").select(
        "path", "language", P.is_changed_test(p).alias("is_changed_test"), P.is_test_file(p).alias("is_test"), P.looks_like_test(p).alias("looks_like_test"), P.is_ci_file(p).alias("is_ci"),
        P.is_source_file(p, F.col("language")).alias("is_source"), P.is_binary(p).alias("is_binary"), P.is_security_path(p).alias("is_security"), P.is_database_path(p).alias("is_database"), P.is_payment_path(p).alias("is_payment"),
    ).distinct()


@query("SELECT DISTINCT trim(name) AS name, symbol_type, CASE WHEN starts_with(trim(name), '_') AND NOT starts_with(trim(name), '__') THEN false WHEN starts_with(trim(name), '__') AND ends_with(trim(name), '__') THEN true WHEN symbol_type = 'method' THEN NOT starts_with(trim(name), '_') ELSE true END AS is_public, "
       f"(symbol_type IN ('function', 'method') AND regexp_matches(lower(trim(name)), '^({'|'.join(K.TEST_FUNCTIONS)})')) AS is_test FROM symbols")
def symbol_predicates(spark, folder):
    n, k = F.trim("name"), F.col("symbol_type")
    return table(spark, folder, "symbols").select(n.alias("name"), "symbol_type", P.is_public_symbol(n, k).alias("is_public"), P.is_test_symbol(n, k).alias("is_test")).distinct()


@query("SELECT DISTINCT path, regexp_replace(replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), '^\\.+', '') AS module, "
       "replace(replace(replace(replace(replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), 'test_', ''), '_test', ''), '.test', ''), '.spec', ''), '_spec', '') AS stem, regexp_replace(path, '/?[^/]*$', '') AS directory FROM file_info")
def path_functions(spark, folder):
    p = F.col("path")
    return table(spark, folder, "file_info").select("path", X.module_of(p).alias("module"), X.clean_stem(p).alias("stem"), X.directory(p).alias("directory")).distinct()


@query("SELECT DISTINCT path, size_bytes, CASE WHEN size_bytes < 1024 THEN round(size_bytes / 1.0, 2)::DOUBLE || ' B' WHEN size_bytes < 1048576 THEN round(size_bytes / 1024.0, 2)::DOUBLE || ' KB' ELSE round(size_bytes / 1048576.0, 2)::DOUBLE || ' MB' END AS size_text FROM files WHERE size_bytes > 0")
def human_sizes(spark, folder):
    return table(spark, folder, "files").where("size_bytes > 0").select("path", "size_bytes", X.human_size(F.col("size_bytes")).alias("size_text")).distinct()


@query("SELECT github_url, regexp_extract(trim(github_url), '^https://github\\.com/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+)/?$', 1) AS owner, regexp_extract(trim(github_url), '^https://github\\.com/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+)/?$', 2) AS name FROM (SELECT DISTINCT replace(github_url, 'code.example', 'github.com') AS github_url FROM repositories)")
def parse_urls(spark, folder):
    u = F.replace("github_url", F.lit("code.example"), F.lit("github.com"))
    return table(spark, folder, "repositories").select(u.alias("github_url")).distinct().select("github_url", repository.parse_url(F.col("github_url")).alias("r")).select("github_url", "r.owner", "r.name")


# --- graphs --------------------------------------------------------------------------------------

_DOWN = f"r AS (SELECT {SEED}::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)"
_UP = f"r AS (SELECT {SEED}::BIGINT AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3)"


def _seed(spark):
    return spark.range(SEED, SEED + 1).toDF("seed")


def _recursive(cte: str, sql: str) -> str:
    return f"WITH RECURSIVE {CTE['e']}, {cte} {sql}"


@query()
def callers_depth1(spark, folder):
    return graph.reached_edges(_seed(spark), A.call_edges(spark, folder), 1, "up")


SQL["callers_depth1"] = f"WITH {CTE['e']} SELECT {SEED}::BIGINT AS seed, src, dst, 1 AS depth FROM e WHERE dst = {SEED}"


@query()
def callers_depth3(spark, folder):
    return graph.reach(_seed(spark), A.call_edges(spark, folder), 3, "up")


SQL["callers_depth3"] = _recursive(_UP, f"SELECT {SEED}::BIGINT AS seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY 2")


@query()
def callees_depth3(spark, folder):
    return graph.reached_edges(_seed(spark), A.call_edges(spark, folder), 3)


SQL["callees_depth3"] = _recursive(_DOWN, f"SELECT {SEED}::BIGINT AS seed, src, dst, (min(depth) + 1)::INTEGER AS depth FROM r JOIN e ON e.src = r.node WHERE depth < 3 GROUP BY 2, 3")


@query()
def blast_radius(spark, folder):
    return graph.blast_radius(_seed(spark), A.call_edges(spark, folder), 3)


SQL["blast_radius"] = _recursive(_UP, f"SELECT {SEED}::BIGINT AS seed, node, min(depth)::INTEGER AS depth, least(min(depth), 2)::INTEGER AS bucket FROM r GROUP BY 2 HAVING min(depth) > 0")

_IMPACT = (
    f"WITH RECURSIVE {CTE['e']}, {_UP}, {_DOWN.replace('r AS', 'd AS').replace(' r ', ' d ').replace('r.', 'd.')}, "
    "b AS (SELECT node, min(depth) AS depth, 'caller' AS w, 0 AS k FROM r GROUP BY 1 HAVING min(depth) > 0 UNION ALL SELECT node, min(depth), 'callee', 2 FROM d GROUP BY 1 HAVING min(depth) > 0), "
    "c AS (SELECT node, depth, CASE WHEN depth = 1 THEN 'direct_' ELSE 'transitive_' END || w AS category, k + CASE WHEN depth = 1 THEN 0 ELSE 1 END AS rank FROM b), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY rank, category, depth) AS rn FROM c) WHERE rn = 1), "
    "i AS (SELECT node, category, depth FROM (SELECT *, row_number() OVER (ORDER BY rank, depth, node) AS n FROM f) WHERE n <= 500) "
)


@query()
def impact_categories(spark, folder):
    return graph.impact(_seed(spark), A.call_edges(spark, folder), 3)


SQL["impact_categories"] = _IMPACT + f"SELECT {SEED}::BIGINT AS seed, node, category, depth::INTEGER AS depth FROM i"


@query()
def impact_summary(spark, folder):
    return graph.impact_summary(graph.impact(_seed(spark), A.call_edges(spark, folder), 3))


SQL["impact_summary"] = _IMPACT + (
    f"SELECT {SEED}::BIGINT AS seed, count(*)::BIGINT AS total, count(*) FILTER (WHERE depth = 1)::BIGINT AS direct, count(*) FILTER (WHERE depth > 1)::BIGINT AS transitive, "
    "count(*) FILTER (WHERE contains(category, 'caller'))::BIGINT AS callers, count(*) FILTER (WHERE contains(category, 'callee'))::BIGINT AS callees, count(*) FILTER (WHERE contains(category, 'caller')) > 0 AS has_callers FROM i"
)


@query()
def multi_seed_dependency(spark, folder):
    seeds = table(spark, folder, "part").where("p_brand = 'Brand#1' and p_size = 50").select(F.col("p_partkey").alias("seed"))
    return graph.reach(seeds, A.call_edges(spark, folder), 2)


SQL["multi_seed_dependency"] = (
    f"WITH RECURSIVE {CTE['e']}, r AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth FROM part WHERE p_brand = 'Brand#1' AND p_size = 50 UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2) "
    "SELECT seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2"
)


@query()
def workflow_bounded(spark, folder):
    return graph.workflow(_seed(spark), A.call_edges(spark, folder), 3)[0]


SQL["workflow_bounded"] = _recursive(_DOWN, f"SELECT {SEED}::BIGINT AS seed, node, min(depth)::INTEGER AS depth FROM r GROUP BY 2 ORDER BY 3, 2 LIMIT 100")


@query()
def workflow_summary(spark, folder):
    return graph.workflow(_seed(spark), A.call_edges(spark, folder), 3)[2]


SQL["workflow_summary"] = _recursive(
    _DOWN, f", n AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), t AS (SELECT count(*) AS k FROM e WHERE src IN (SELECT node FROM n WHERE depth < 3)) "
    f"SELECT {SEED}::BIGINT AS seed, max(depth)::INTEGER AS depth, least(count(*), 100)::BIGINT AS nodes, least(any_value(t.k), 200)::BIGINT AS edges, "
    "CASE WHEN count(*) > 100 THEN 'max_nodes_reached' WHEN any_value(t.k) > 200 THEN 'max_edges_reached' END AS reason FROM n, t"
)


@query()
def workflow_tree(spark, folder):
    t = graph.tree_paths(_seed(spark), A.call_edges(spark, folder), 3)
    return t.select("seed", "node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "again")


SQL["workflow_tree"] = _recursive(
    f"{_DOWN}, n AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), x AS (SELECT e.src, e.dst, s.depth + 1 AS depth, d.depth AS least FROM n s JOIN e ON e.src = s.node JOIN n d ON d.node = e.dst WHERE s.depth < 3), "
    "o AS (SELECT dst, min(src) AS src FROM x WHERE depth = least GROUP BY 1), "
    f"p AS (SELECT {SEED}::BIGINT AS node, '{SEED}' AS path UNION ALL SELECT o.dst, p.path || ',' || o.dst FROM p JOIN o ON o.src = p.node)",
    f"SELECT {SEED}::BIGINT AS seed, {SEED}::BIGINT AS node, 0::INTEGER AS depth, '{SEED}' AS path, false AS again UNION ALL SELECT {SEED}, x.dst, x.depth::INTEGER, p.path || ',' || x.dst, NOT (x.depth = x.least AND x.src = o.src) FROM x JOIN p ON p.node = x.src LEFT JOIN o ON o.dst = x.dst",
)


@query("SELECT DISTINCT c.id AS source_id, m.id AS target_id FROM symbols c JOIN symbols m ON m.parent_symbol_id = c.id WHERE c.symbol_type = 'class' AND m.symbol_type = 'method'")
def contains_relationships(spark, folder):
    return graph.contains_links(table(spark, folder, "symbols"))


@query("SELECT DISTINCT s.id, CASE WHEN p.name IS NULL THEN trim(s.name) ELSE trim(p.name) || '.' || trim(s.name) END AS qualified_name FROM symbols s LEFT JOIN (SELECT id, min(name) AS name FROM symbols GROUP BY 1) p ON p.id = s.parent_symbol_id")
def parent_self_join(spark, folder):
    return graph.qualified_names(table(spark, folder, "symbols")).select("id", "qualified_name").distinct()


@query("WITH s AS (SELECT DISTINCT * FROM symbols), c AS (SELECT s.name AS caller_name, s.file_id, s.analysis_run_id, p.name AS callee_name, s.start_line AS line FROM s JOIN (SELECT DISTINCT id, name FROM symbols) p ON p.id = s.parent_symbol_id) "
       "SELECT DISTINCT a.id AS src, b.id AS dst, c.line FROM c JOIN s a ON a.name = c.caller_name AND a.file_id = c.file_id AND a.analysis_run_id = c.analysis_run_id JOIN s b ON b.name = c.callee_name AND b.analysis_run_id = c.analysis_run_id")
def call_edges_resolved(spark, folder):
    """Every symbol calls what has the name of its parent, as constructors and recursive methods do."""
    s = table(spark, folder, "symbols").distinct()
    parents = s.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("callee_name")).distinct()
    calls = s.join(parents, "parent_symbol_id").select(F.col("name").alias("caller_name"), "callee_name", "file_id", "analysis_run_id", F.col("start_line").alias("line_number"))
    return graph.resolve_calls(calls, s)


_IMPORTS = (
    "i AS (SELECT DISTINCT repository_id AS run, path AS importer, s AS source, regexp_replace(path, '/?[^/]*$', '') AS folder FROM (SELECT repository_id, path, unnest(regexp_extract_all(content, 'from ''([^'']+)''', 1)) AS s FROM file_info)), "
    "b AS (SELECT *, list_filter(string_split(folder, '/'), lambda x: x <> '') AS parts, (len(source) - len(replace(source, '../', ''))) // 3 AS ups, regexp_replace(source, '^(\\./|(\\.\\./)+)', '') AS rest FROM i), "
    "t AS (SELECT *, CASE WHEN starts_with(source, './') THEN CASE WHEN folder = '' THEN rest ELSE folder || '/' || rest END WHEN starts_with(source, '../') AND ups <= len(parts) THEN CASE WHEN len(parts) = ups THEN rest ELSE array_to_string(parts[1:len(parts) - ups], '/') || '/' || rest END END AS base FROM b), "
    f"h AS (SELECT DISTINCT run, importer, source, base || x AS target FROM (SELECT *, unnest([{_in(K.IMPORT_SUFFIXES)}]) AS x FROM t) WHERE (run, base || x) IN (SELECT repository_id, path FROM file_info)) "
)


@query()
def import_resolution(spark, folder):
    f = table(spark, folder, "file_info")
    imports = f.select(F.col("repository_id").alias("analysis_run_id"), "path", F.explode(F.regexp_extract_all("content", F.lit("from '([^']+)'"), F.lit(1))).alias("source"))
    found = graph.resolve_imports(imports, f.select(F.col("repository_id").alias("analysis_run_id"), "path"))
    return found.select(F.col("analysis_run_id").alias("run"), "importer", "source", "target", "kind")


SQL["import_resolution"] = f"WITH {_IMPORTS} SELECT run, importer, source, target, 'file' AS kind FROM h UNION ALL SELECT run, importer, source, source, 'external_module' FROM i WHERE (run, importer, source) NOT IN (SELECT run, importer, source FROM h)"

_HANDLERS = "ep AS (SELECT DISTINCT file_id, trim(name) AS handler_name, 'GET' AS method, '/' || lower(trim(name)) AS path FROM symbols WHERE language = 'TypeScript')"


def _endpoints(spark, folder):
    name = F.trim("name")
    return table(spark, folder, "symbols").where("language = 'TypeScript'").select("file_id", name.alias("handler_name"), F.lit("GET").alias("method"), F.concat(F.lit("/"), F.lower(name)).alias("path")).distinct()


@query(f"WITH {_HANDLERS}, p AS (SELECT file_id, name AS handler_name, id, CASE symbol_type WHEN 'function' THEN 0 WHEN 'method' THEN 1 WHEN 'arrow_function' THEN 2 END AS rank FROM symbols), b AS (SELECT file_id, handler_name, arg_min(id, (rank, id)) AS symbol_id FROM p WHERE rank IS NOT NULL GROUP BY 1, 2) SELECT ep.file_id, ep.handler_name, method, path, symbol_id FROM ep LEFT JOIN b ON b.file_id = ep.file_id AND b.handler_name = ep.handler_name")
def handler_priority_lookup(spark, folder):
    return graph.resolve_handlers(_endpoints(spark, folder), table(spark, folder, "symbols")).select("file_id", "handler_name", "method", "path", "symbol_id")


@query(f"WITH {_HANDLERS} SELECT file_id, handler_name, method, path FROM ep WHERE contains(lower(path), 'list') ORDER BY path, file_id LIMIT 100")
def endpoint_filter_page(spark, folder):
    e = _endpoints(spark, folder).where(F.contains(F.lower("path"), F.lit("list"))).select("file_id", "handler_name", "method", "path")
    return ordering.page(e, F.col("path"), F.col("file_id"), size=100)


@query("SELECT DISTINCT i.path, f.id AS file_id FROM (SELECT DISTINCT repository_id, path FROM file_info) i LEFT JOIN (SELECT repository_id, path, min(id) AS id FROM files GROUP BY 1, 2) f ON f.repository_id = i.repository_id AND f.path = i.path")
def path_lookup_left(spark, folder):
    ids = table(spark, folder, "files").groupBy("repository_id", "path").agg(F.min("id").alias("file_id"))
    return table(spark, folder, "file_info").select("repository_id", "path").distinct().join(ids, ["repository_id", "path"], "left").select("path", "file_id").distinct()


@query(f"WITH {CTE['e']} SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM e) WHERE n <= 20")
def endpoint_dependencies_topn(spark, folder):
    return ordering.top_of(A.call_edges(spark, folder), ["src"], 20, F.col("dst"))


# --- search --------------------------------------------------------------------------------------

_VECTOR = [round(((i * 37) % 64 - 32) / 100, 2) for i in range(64)]
_VEC_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR) + "]"
_SEM = f"SELECT chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], {_VEC_SQL}), 6) AS semantic_score FROM %s WHERE embedding IS NOT NULL %s ORDER BY 2 DESC, 1 LIMIT %d"


def _kw_sql(table_: str, limit: int, where: str = "") -> str:
    words = WORDS.split()
    tf = lambda w: f"len(list_filter(toks, lambda t: t = '{w}'))::DOUBLE"
    score = " + ".join(f"{tf(w)} / ({tf(w)} + 1)" for w in words)
    need = " AND ".join(f"list_contains(toks, '{w}')" for w in words)
    return (
        f"SELECT * FROM (SELECT chunk_id, round(({score}) / (1 + ln(greatest(len(toks), 1)::DOUBLE)), 6) AS keyword_score FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda t: t <> '') AS toks "
        f"FROM {table_} WHERE content IS NOT NULL {where}) WHERE {need}) WHERE keyword_score > 0 ORDER BY 2 DESC, 1 LIMIT {limit}"
    )


@query(_SEM % ("cv", "", 10), "cv")
def semantic_topk(spark, folder):
    return search.semantic(A.vectors(spark, folder), _VECTOR)


@query(_SEM % ("cv", "AND label = 3", 10), "cv")
def semantic_topk_by_type(spark, folder):
    return search.semantic(A.vectors(spark, folder), _VECTOR, where=F.col("label") == 3)


@query(_kw_sql("cu", 20), "cu")
def keyword_topk(spark, folder):
    return search.keyword(A.chunks(spark, folder), WORDS, 20)


@query("SELECT * FROM (SELECT chunk_id, round((n / (n + 1)) / (1 + ln(greatest(w, 1)::DOUBLE)), 6) AS keyword_score FROM (SELECT chunk_id, ((length(l) - length(replace(l, 'the parser', ''))) / 10.0)::DOUBLE AS n, "
       "len(list_filter(regexp_split_to_array(l, '[^a-z0-9]+'), lambda t: t <> '')) AS w FROM (SELECT chunk_id, lower(content) AS l FROM cu WHERE content IS NOT NULL)) WHERE n > 0) ORDER BY 2 DESC, 1 LIMIT 20", "cu")
def keyword_phrase_topk(spark, folder):
    return search.keyword(A.chunks(spark, folder), '"the parser"', 20)


@query("SELECT chunk_id, round((a / (a + 1) + b / (b + 1) + c / (c + 1)) / (1 + ln(greatest(w, 1)::DOUBLE)), 6) AS keyword_score FROM (SELECT chunk_id, len(list_filter(t, lambda x: x = 'cache'))::DOUBLE AS a, len(list_filter(t, lambda x: x = 'parser'))::DOUBLE AS b, "
       "len(list_filter(t, lambda x: x = 'layer'))::DOUBLE AS c, len(list_filter(t, lambda x: x = 'error')) AS d, len(t) AS w FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM cu WHERE content IS NOT NULL)) WHERE (a > 0 OR b > 0) AND c > 0 AND d = 0 ORDER BY 2 DESC, 1 LIMIT 20", "cu")
def keyword_alternatives_topk(spark, folder):
    return search.keyword(A.chunks(spark, folder), "cache or parser layer -error", 20)


@query("SELECT chunk_id, round((a / (a + 1)) / (1 + ln(greatest(w, 1)::DOUBLE)), 6) AS keyword_score FROM (SELECT chunk_id, len(list_filter(t, lambda x: x IN ('pars', 'parsing', 'parsies', 'parsied', 'parsy', 'parses', 'parsed', 'parse', 'parss')))::DOUBLE AS a, len(t) AS w FROM (SELECT chunk_id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM cu WHERE content IS NOT NULL)) WHERE a > 0 ORDER BY 2 DESC, 1 LIMIT 20", "cu")
def keyword_forms_topk(spark, folder):
    return search.keyword(A.chunks(spark, folder), "parsing", 20, forms=True)


@query(_kw_sql("cu", 20, "AND chunk_type = 'docs'"), "cu")
def keyword_topk_by_type(spark, folder):
    return search.keyword(A.chunks(spark, folder), WORDS, 20, F.col("chunk_type") == "docs")


_FUSED = (
    f"s AS ({_SEM % ('cu', '', 40)}), k0 AS ({_kw_sql('cu', 40)}), k AS (SELECT chunk_id, CASE WHEN max(keyword_score) OVER () = min(keyword_score) OVER () THEN 1.0::DOUBLE ELSE (keyword_score - min(keyword_score) OVER ()) / (max(keyword_score) OVER () - min(keyword_score) OVER ()) END AS keyword_score FROM k0), "
    "f AS (SELECT coalesce(s.chunk_id, k.chunk_id) AS chunk_id, semantic_score, keyword_score, round(0.5 * coalesce(semantic_score, 0) + 0.5 * coalesce(keyword_score, 0), 6) AS final_score, CASE WHEN s.chunk_id IS NOT NULL AND k.chunk_id IS NOT NULL THEN 'hybrid' WHEN s.chunk_id IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS source FROM s FULL JOIN k ON k.chunk_id = s.chunk_id)"
)


@query(f"WITH {CTE['cu']}, {_FUSED} SELECT * FROM f ORDER BY final_score DESC, chunk_id DESC LIMIT 20")
def hybrid_topk(spark, folder):
    return search.hybrid(A.chunks(spark, folder), WORDS, _VECTOR, 20)


@query(f"WITH {CTE['cu']}, {_FUSED}, b AS (SELECT chunk_id, final_score, CASE WHEN length(content) > 2000 THEN left(content, 2000) || chr(10) || '... [truncated]' ELSE content END AS content FROM f JOIN cu USING (chunk_id) ORDER BY final_score DESC, chunk_id DESC LIMIT 20), r AS (SELECT *, sum(length(content)) OVER (ORDER BY final_score DESC, chunk_id DESC ROWS UNBOUNDED PRECEDING) AS running FROM b) SELECT chunk_id, final_score, running::BIGINT AS running FROM r WHERE running <= 15000")
def rag_budget(spark, folder):
    c = A.chunks(spark, folder)
    found = search.hybrid(c, WORDS, _VECTOR, 20).join(c.select("chunk_id", "content"), "chunk_id")
    return search.within_budget(found).select("chunk_id", "final_score", "running")


@query(f"WITH {CTE['cu']}, {_FUSED}, t AS (SELECT * FROM f ORDER BY final_score DESC, chunk_id DESC LIMIT 20) SELECT count(*)::BIGINT AS candidates, count(*) FILTER (WHERE semantic_score > 0)::BIGINT AS semantic_candidates, count(*) FILTER (WHERE keyword_score > 0)::BIGINT AS keyword_candidates FROM t")
def rag_metadata(spark, folder):
    return search.retrieval_counts(search.hybrid(A.chunks(spark, folder), WORDS, _VECTOR, 20))


@query()
def chunk_split(spark, folder):
    return search.split_chunks(A.chunks(spark, folder))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS chunk_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def chunk_dedupe(spark, folder):
    return search.distinct_chunks(A.chunks(spark, folder))


@query("SELECT doc_id, (length(text) // 4)::INTEGER AS tokens FROM documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_ANSWERS = "a AS (SELECT doc_id AS answer_id, 'See [Evidence ' || (doc_id % 7) || '] and [Evidence ' || (doc_id % 3) || '], then [Evidence ' || (doc_id % 7) || ']. ' || coalesce(text, '') AS answer, (doc_id % 5)::INTEGER AS n_evidence FROM documents)"


def _answers(spark, folder):
    d = table(spark, folder, "documents")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    text = F.concat(F.lit("See [Evidence "), n(7), F.lit("] and [Evidence "), n(3), F.lit("], then [Evidence "), n(7), F.lit("]. "), F.coalesce("text", F.lit("")))
    return d.select(F.col("doc_id").alias("answer_id"), text.alias("answer"), (F.col("doc_id") % 5).cast("int").alias("n_evidence"))


@query(f"WITH {_ANSWERS} SELECT answer_id, (i - 1)::INTEGER AS position, n AS evidence FROM (SELECT answer_id, n_evidence, i, u[i] AS n FROM (SELECT answer_id, n_evidence, u, unnest(generate_series(1, len(u))) AS i FROM (SELECT answer_id, n_evidence, list_transform(regexp_extract_all(answer, '\\[Evidence (\\d+)\\]', 1), lambda x: x::INTEGER) AS l, list_filter(l, lambda x, k: list_position(l, x) = k) AS u FROM a))) WHERE n BETWEEN 1 AND n_evidence")
def citations(spark, folder):
    return search.citations(_answers(spark, folder))


@query(f"WITH {_ANSWERS} SELECT answer_id, (n_evidence >= 2 AND NOT {_any('lower(answer)', K.INSUFFICIENT_PHRASES)}) AS sufficient FROM a")
def sufficiency(spark, folder):
    return _answers(spark, folder).select("answer_id", P.is_sufficient(F.col("answer"), F.col("n_evidence")).alias("sufficient"))


_NAMES_SQL = "SELECT DISTINCT trim(name) AS name FROM symbols"


@query(f"SELECT name, round(CASE WHEN lower(name) = 'renderpage' THEN 1.0 WHEN contains(lower(name), 'renderpage') OR contains('renderpage', lower(name)) THEN least(len(name), 10) / greatest(len(name), 10) ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END::DOUBLE, 6) AS score FROM (SELECT name, list_distinct(string_split(lower(name), '')) AS x, list_distinct(string_split('renderpage', '')) AS y FROM ({_NAMES_SQL}))")
def name_similarity(spark, folder):
    n = table(spark, folder, "symbols").select(F.trim("name").alias("name")).distinct()
    return n.select("name", F.round(X.name_similarity(F.lit("renderPage"), F.col("name")), 6).alias("score"))


_Q = "models/api/index.ts"


@query(f"SELECT path, round(CASE WHEN p = '{_Q}' THEN 1.0 WHEN ends_with(p, '{_Q}') THEN 0.95 WHEN contains(p, '{_Q}') THEN 0.8 ELSE len(list_filter(list_zip(list_reverse(string_split(p, '/')), list_reverse(string_split('{_Q}', '/'))), lambda z: z[1] = z[2])) / greatest(len(string_split(p, '/')), 3) END::DOUBLE, 6) AS score FROM (SELECT DISTINCT path, lower(replace(path, chr(92), '/')) AS p FROM files)")
def path_similarity(spark, folder):
    return table(spark, folder, "files").select("path").distinct().select("path", F.round(X.path_similarity(F.lit(_Q), F.col("path")), 6).alias("score"))


_INTENT = ", ".join("(" + " + ".join(f"regexp_matches(q, $${p}$$, 'i')::INTEGER" for p in ps) + f") AS s{i}" for i, ps in enumerate(K.INTENT_PATTERNS.values()))
_BEST = "CASE " + " ".join(f"WHEN s{i} = m THEN '{n}'" for i, n in enumerate(K.INTENT_PATTERNS)) + " END"


def _intent_sql(question: str) -> str:
    return (
        f"SELECT doc_id, CASE WHEN short AND regexp_matches(q, $${'|'.join(K.CONTEXT_DEPENDENCY)}$$, 'i') THEN 'dependency_question' WHEN short AND regexp_matches(q, $${'|'.join(K.CONTEXT_DETAIL)}$$, 'i') THEN 'symbol_explanation' WHEN m > 0 THEN {_BEST} ELSE 'unknown' END AS intent, "
        f"CASE WHEN short AND regexp_matches(q, $${'|'.join(K.CONTEXT_DEPENDENCY + K.CONTEXT_DETAIL)}$$, 'i') THEN 0.7 WHEN m > 0 THEN least(m / 2.0, 1.0) ELSE 0.5 END::DOUBLE AS confidence "
        f"FROM (SELECT *, greatest({', '.join(f's{i}' for i in range(len(K.INTENT_PATTERNS)))}) AS m, (len(list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda w: w <> '')) <= 4 AND doc_id % 2 = 0) AS short FROM (SELECT doc_id, q, {_INTENT} FROM (SELECT doc_id, {question} AS q FROM documents WHERE text IS NOT NULL)))"
    )


@query(_intent_sql("text"))
def intent_classification(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return P.intents(d, "text", F.col("doc_id") % 2 == 0).select("doc_id", "intent", "confidence")


@query()
def target_identification(spark, folder):
    q = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    s = A.located_symbols(spark, folder)
    ends = _endpoints(spark, folder).withColumn("id", F.sha2(F.concat("file_id", "path"), 256))
    return targets.identify(q, s, table(spark, folder, "files").select("id", "path").distinct(), ends)


@query(f"WITH {_HANDLERS} SELECT DISTINCT 'file' AS kind, id, path AS label FROM files WHERE contains(lower(path), 'token') UNION ALL SELECT DISTINCT 'symbol', id, name FROM symbols WHERE contains(lower(name), 'token') UNION ALL SELECT 'endpoint', file_id, path FROM ep WHERE contains(lower(path), 'token')")
def global_search(spark, folder):
    e = _endpoints(spark, folder).select(F.col("file_id").alias("id"), "path", "handler_name", F.lit("").alias("file_path"))
    return targets.global_search("token", table(spark, folder, "files").select("id", "path").distinct(), table(spark, folder, "symbols").select("id", "name").distinct(), e)


@query("SELECT DISTINCT i.item_id, d.doc_id FROM benchmark i JOIN documents d ON contains(d.text, i.text)")
def substring_theta_join(spark, folder):
    found = search.containing(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", F.col("text").alias("part")))
    return found.select("item_id", "doc_id").distinct()


_CLEAN = "text"
for _p, _new in K.SECRET_PATTERNS:
    _CLEAN = f"regexp_replace({_CLEAN}, $${_p}$$, $${_new.replace('$1', chr(92) + '1')}$$, 'g')"


@query(f"SELECT doc_id, {_CLEAN} AS clean FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' token: abcdefghijklmnopqrstuvwxyz0123' WHEN 1 THEN ' password = hunter2' WHEN 2 THEN ' redis://user:secret@host' WHEN 3 THEN ' postgresql+psycopg://u:p@db' ELSE '' END AS text FROM documents)")
def secret_sanitise(spark, folder):
    n = (F.col("doc_id") % 5).cast("int")
    tails = F.array(*[F.lit(x) for x in (" token: abcdefghijklmnopqrstuvwxyz0123", " password = hunter2", " redis://user:secret@host", " postgresql+psycopg://u:p@db", "")])
    d = table(spark, folder, "documents").select("doc_id", F.concat("text", F.get(tails, n)).alias("text"))
    return d.select("doc_id", X.sanitised(F.col("text")).alias("clean"))


# --- tests -----------------------------------------------------------------------------------------

_COUNTS = "count(*)::BIGINT AS total_tests, count(*) FILTER (WHERE outcome = 'passed')::BIGINT AS passed_tests, count(*) FILTER (WHERE outcome = 'failed')::BIGINT AS failed_tests, count(*) FILTER (WHERE outcome = 'skipped')::BIGINT AS skipped_tests, count(*) FILTER (WHERE outcome = 'error')::BIGINT AS error_tests, nullif(sum(duration_ms), 0)::BIGINT AS total_duration_ms"


@query(f"SELECT test_run_id, {_COUNTS} FROM tc GROUP BY 1", "tc")
def report_counters(spark, folder):
    return testresults.counters(A.test_cases(spark, folder))


_PRINT = "SELECT test_run_id, sha256('format:junit|total:' || count(*) || '|' || string_agg(full_name || ':' || outcome, '|' ORDER BY full_name || ':' || outcome)) AS content_fingerprint FROM tc GROUP BY 1"


@query(_PRINT, "tc")
def report_fingerprint(spark, folder):
    return testresults.fingerprints(A.test_cases(spark, folder), "junit")


@query(f"SELECT 'all' AS repository_id, content_fingerprint, test_run_id FROM ({_PRINT}) WHERE test_run_id >= '2024-01-15'", "tc")
def idempotent_import(spark, folder):
    prints = testresults.fingerprints(A.test_cases(spark, folder), "junit").withColumn("repository_id", F.lit("all"))
    return testresults.new_runs(prints, prints.where("test_run_id < '2024-01-15'")).select("repository_id", "content_fingerprint", "test_run_id")


_T = "concat_ws(' ', failure_type, failure_message, failure_stacktrace)"
_HITS = {k: f"regexp_matches({_T}, $${'|'.join(f'(?:{p})' for p in ps)}$$, 'i')" for k, ps in K.FAILURE_PATTERNS.items()}
_NAMED = {"assertion": "assert", "import_error": "import", "timeout": "timeout"}
_SURE = {"setup_error": "0.80", "dependency_error": "0.75", "network_error": "0.75"}


@query(f"SELECT event_id, CASE WHEN trim({_T}) = '' THEN 'unknown' {' '.join(f'''WHEN {h} THEN '{k}' ''' for k, h in _HITS.items())} ELSE 'unknown' END AS failure_class, (CASE WHEN trim({_T}) = '' THEN 0.00 "
       + " ".join(f"WHEN {h} THEN " + (f"CASE WHEN contains(lower(coalesce(failure_type, '')), '{_NAMED[k]}') THEN 0.95 ELSE 0.85 END" if k in _NAMED else _SURE[k]) for k, h in _HITS.items())
       + " ELSE 0.50 END)::DOUBLE AS confidence FROM fl", "fl")
def failure_classification(spark, folder):
    return testresults.classified(A.failures(spark, folder)).select("event_id", "failure_class", F.col("confidence").cast("double").alias("confidence"))


_TRENDS = (
    f"{CTE['tc']}, cur AS (SELECT * FROM tc WHERE imported_at = TIMESTAMP '{TODAY}'), past AS (SELECT * FROM tc WHERE imported_at < TIMESTAMP '{TODAY}' AND imported_at >= TIMESTAMP '{TODAY}' - INTERVAL 30 DAY), "
    "h AS (SELECT full_name, count(*) AS n, count(*) FILTER (WHERE outcome = 'passed') AS p, count(*) FILTER (WHERE outcome IN ('failed', 'error')) AS f, arg_max(outcome, imported_at) AS last, list_sort(list(duration_ms) FILTER (WHERE duration_ms > 0)) AS d FROM past GROUP BY 1), "
    "j AS (SELECT cur.full_name, outcome, duration_ms, n, p, f, last, d[len(d) // 2 + 1] AS med FROM cur LEFT JOIN h ON h.full_name = cur.full_name), "
    "t AS (SELECT full_name, n, unnest([CASE WHEN n IS NULL AND outcome = 'failed' THEN 'new_test_failure' END, CASE WHEN outcome IN ('failed', 'error') AND f >= 2 THEN 'repeated_failure' END, CASE WHEN outcome IN ('failed', 'error') AND last = 'passed' THEN 'regression' END, CASE WHEN outcome = 'passed' AND last IN ('failed', 'error') THEN 'fixed' END, "
    "CASE WHEN n >= 5 AND p + f >= 5 AND p / (p + f) >= 0.2 AND f / (p + f) >= 0.2 THEN 'potentially_flaky' END, CASE WHEN outcome = 'passed' AND duration_ms > 2 * med THEN 'duration_increase' END]) AS trend_type FROM j)"
)


@query(f"WITH {_TRENDS} SELECT 'all' AS repository_id, full_name, trend_type, coalesce(n, 0)::BIGINT AS runs FROM t WHERE trend_type IS NOT NULL")
def trend_detection(spark, folder):
    return testresults.trends(A.test_cases(spark, folder), TODAY)


@query(f"WITH {_TRENDS} SELECT trend_type, count(*)::BIGINT AS n FROM t WHERE trend_type IS NOT NULL GROUP BY 1")
def trend_counts(spark, folder):
    return testresults.trends(A.test_cases(spark, folder), TODAY).groupBy("trend_type").agg(F.count(F.lit(1)).alias("n"))


def _tests(spark, folder):
    """One row for each test file and import of it; a file without imports has one row."""
    f = table(spark, folder, "file_info").where(P.is_test_file(F.col("path"))).select("path").distinct()
    none = F.lit("")
    i = A.imports(spark, folder).select("path", "source", "imported_names").distinct()
    return f.join(i, "path", "left").select("path", X.filename(F.col("path")).alias("name"), F.coalesce("source", none).alias("source"), F.coalesce("imported_names", none).alias("imported_names"))


_TESTS = (
    f"{CTE['im']}, ti AS (SELECT DISTINCT f.path, list_last(string_split(f.path, '/')) AS name, coalesce(source, '') AS source, coalesce(imported_names, '') AS imported_names "
    f"FROM (SELECT DISTINCT path FROM file_info WHERE {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}) f LEFT JOIN (SELECT DISTINCT path, source, imported_names FROM im) i ON i.path = f.path)"
)


@query(f"WITH {_TESTS}, u AS (SELECT path, name, unnest(list_filter(list_transform(string_split(imported_names, ','), lambda x: trim(x)), lambda x: x <> '')) AS target FROM ti) SELECT DISTINCT path, name, target FROM u WHERE target IN (SELECT name FROM symbols)")
def affected_tests(spark, folder):
    return coverage.by_import(_tests(spark, folder), table(spark, folder, "symbols").select("name"))


@query(f"WITH {_TESTS}, u AS (SELECT unnest(list_filter(list_transform(string_split(imported_names, ','), lambda x: trim(x)), lambda x: x <> '')) AS target FROM ti), {CTE['sy']} SELECT path, count(DISTINCT name)::BIGINT AS n_symbols, CASE WHEN count(DISTINCT name) > 5 THEN 'high' WHEN count(DISTINCT name) > 2 THEN 'medium' ELSE 'low' END AS severity FROM sy WHERE name NOT IN (SELECT target FROM u) GROUP BY 1")
def uncovered_areas(spark, folder):
    return coverage.uncovered(A.located_symbols(spark, folder), coverage.by_import(_tests(spark, folder), table(spark, folder, "symbols").select("name")))


def _stem(path: str) -> str:
    base = f"regexp_replace(list_last(string_split({path}, '/')), '\\.[^.]*$', '')"
    for mark in ("test_", "_test", ".test", ".spec", "_spec"):
        base = f"replace({base}, '{mark}', '')"
    return base


@query(f"SELECT DISTINCT t.path, s.path AS target FROM (SELECT DISTINCT path FROM file_info WHERE {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}) t JOIN (SELECT DISTINCT path FROM file_info WHERE NOT {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}) s ON {_stem('t.path')} = {_stem('s.path')} AND t.path <> s.path")
def test_siblings(spark, folder):
    f = table(spark, folder, "file_info").select("path").distinct()
    return coverage.by_sibling(f.where(P.is_test_file(F.col("path"))), f.where(~P.is_test_file(F.col("path"))))


_MODULE = "regexp_replace(replace(regexp_replace({0}, '\\.[^./]*$', ''), '/', '.'), '^\\.+', '')"
_PARTS = "array_to_string(list_filter(regexp_split_to_array(regexp_replace({0}, '\\.(py|js|jsx|ts|tsx)$', ''), '[./\\\\]+'), lambda x: x <> ''), '.')"
_BARE_DIR = "array_to_string(list_filter(string_split(regexp_replace({0}, '/?[^/]*$', ''), '/'), lambda d: d NOT IN ('tests', 'test', '__tests__')), '/')"
_USED = "list_filter(list_transform(string_split(imported_names, ','), lambda x: trim(x)), lambda x: x <> '')"


@query(
    f"WITH {_TESTS}, {CTE['df']}, so AS (SELECT DISTINCT path AS target FROM file_info WHERE NOT {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}), u AS (SELECT path, unnest({_USED}) AS n FROM ti), "
    f"mo AS (SELECT target, {_PARTS.format(_MODULE.format('target'))} AS m FROM so), us AS (SELECT DISTINCT path, {_PARTS.format('source')} AS s FROM ti), tp AS (SELECT DISTINCT path FROM ti), "
    "r AS (SELECT DISTINCT u.path, df.path AS target, 0 AS rank FROM u JOIN df ON df.name = u.n JOIN so ON so.target = df.path "
    "UNION SELECT us.path, target, 1 FROM us JOIN mo ON us.s <> '' AND mo.m <> '' AND (contains('.' || us.s || '.', '.' || mo.m || '.') OR contains('.' || mo.m || '.', '.' || us.s || '.')) "
    f"UNION SELECT tp.path, target, 2 FROM tp JOIN so ON {_stem('tp.path')} = {_stem('so.target')} AND tp.path <> target "
    f"UNION SELECT tp.path, target, 3 FROM tp JOIN so ON {_BARE_DIR.format('tp.path')} = {_BARE_DIR.format('so.target')} AND tp.path <> target AND contains(lower(tp.path), lower({_stem('so.target')}))) "
    "SELECT path, target, ['direct_import', 'indirect_import', 'sibling_module', 'path_pattern'][min(rank) + 1] AS relationship, ['high', 'medium', 'medium', 'low'][min(rank) + 1] AS confidence FROM r GROUP BY 1, 2"
)
def source_to_tests(spark, folder):
    f = table(spark, folder, "file_info").select("path").distinct()
    return coverage.tests_of_sources(_tests(spark, folder), A.definitions(spark, folder).select("path", "name"), f.where(~P.is_test_file(F.col("path"))))


_NAME_WORDS = "array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), '_')"


@query(
    f"WITH {_TESTS}, sn AS (SELECT DISTINCT trim(name) AS target FROM symbols), w AS (SELECT target, {_NAME_WORDS.format('target')} AS k FROM sn WHERE length(target) > 2), tn AS (SELECT DISTINCT path, name, {_NAME_WORDS.format('name')} AS k FROM ti), "
    f"r AS (SELECT path, name, target, 0 AS rank FROM (SELECT DISTINCT path, name, unnest({_USED}) AS target FROM ti) WHERE target IN (SELECT target FROM sn) UNION SELECT path, name, target, 1 FROM tn JOIN w ON w.k <> '' AND contains('_' || tn.k || '_', '_' || w.k || '_')) "
    "SELECT path, name, target, CASE min(rank) WHEN 0 THEN 'high' ELSE 'low' END AS confidence FROM r GROUP BY 1, 2, 3"
)
def symbol_to_tests(spark, folder):
    return coverage.tests_of_symbols(_tests(spark, folder), table(spark, folder, "symbols").select(F.trim("name").alias("name")).distinct())


_FRAMEWORK = (
    "CASE " + " ".join(f"WHEN list_has_any(coalesce(roots, []), [{_in(m)}]) THEN '{n}'" for n, m in K.FRAMEWORKS.items())
    + " ELSE coalesce(CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.DEFAULT_FRAMEWORKS.items()) + " END, 'unknown') END"
)


@query(
    f"WITH {CTE['im']}, {CTE['df']}, f AS (SELECT DISTINCT repository_id || '/' || path AS file_id, path, language FROM file_info WHERE {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}), "
    f"c AS (SELECT repository_id || '/' || path AS file_id, count(*) AS n FROM df WHERE regexp_matches(lower(name), '^({'|'.join(K.TEST_FUNCTIONS)})') GROUP BY 1), "
    "r AS (SELECT repository_id || '/' || path AS file_id, list(DISTINCT string_split(source, '.')[1]) AS roots, count(*) AS n FROM im GROUP BY 1) "
    f"SELECT f.file_id, path, {_FRAMEWORK} AS framework, coalesce(c.n, 0)::BIGINT AS n_tests, coalesce(r.n, 0)::BIGINT AS n_imports FROM f LEFT JOIN c USING (file_id) LEFT JOIN r USING (file_id)"
)
def test_inventory(spark, folder):
    key = F.concat_ws("/", "repository_id", "path").alias("file_id")
    files = table(spark, folder, "file_info").select(key, "path", "language").distinct()
    defined = A.definitions(spark, folder).select(key, "name", F.lit("function").alias("symbol_type"))
    return coverage.test_inventory(files, defined, A.imports(spark, folder).select(key, "source"))


@query(f"SELECT DISTINCT path, CASE WHEN {_any('both_', ['e2e', 'end_to_end'])} THEN 'e2e' WHEN contains(lower(path), 'integration') OR contains(n, 'integr') THEN 'integration' WHEN {_any('both_', ['functional', 'feature'])} THEN 'functional' WHEN contains(both_, 'unit') THEN 'unit' WHEN list_has_any(string_split(lower(path), '/'), ['test', 'tests']) THEN 'unit' ELSE 'unknown' END AS test_type FROM (SELECT path, lower(list_last(string_split(path, '/'))) AS n, lower(path) || ' ' || lower(list_last(string_split(path, '/'))) AS both_ FROM file_info)")
def test_types(spark, folder):
    p = F.col("path")
    return table(spark, folder, "file_info").select("path", P.test_type(X.filename(p), p).alias("test_type")).distinct()


@query("SELECT doc_id, CASE ext WHEN 'py' THEN 'pytest ' || path || ' -v' WHEN 'js' THEN 'npm test ' || path WHEN 'ts' THEN 'npm test ' || path WHEN 'jsx' THEN 'npm test ' || path WHEN 'tsx' THEN 'npm test ' || path WHEN 'go' THEN 'go test ' || path WHEN 'rs' THEN 'cargo test --test ' || path WHEN 'java' THEN 'mvn test -Dtest=' || path ELSE '# Run tests in ' || path END AS command FROM (SELECT doc_id, path, lower(list_last(string_split(path, '.'))) AS ext FROM documents WHERE path IS NOT NULL)")
def test_commands(spark, folder):
    return table(spark, folder, "documents").where("path is not null").select("doc_id", P.test_command(F.col("path")).alias("command"))


_COMMAND = "CASE lower(list_last(string_split(p, '.'))) WHEN 'py' THEN 'pytest ' || p || ' -v' WHEN 'js' THEN 'npm test ' || p WHEN 'ts' THEN 'npm test ' || p WHEN 'jsx' THEN 'npm test ' || p WHEN 'tsx' THEN 'npm test ' || p WHEN 'go' THEN 'go test ' || p WHEN 'rs' THEN 'cargo test --test ' || p WHEN 'java' THEN 'mvn test -Dtest=' || p ELSE '# Run tests in ' || p END"


@query(
    f"WITH k AS (SELECT {_EXT} AS kind, path, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') AS parts FROM file_info WHERE {_test_sql('path', K.TEST_DIRS, K.TEST_NAMES)}), "
    "g AS (SELECT kind, count(DISTINCT path) AS n, min(parts) AS a, max(parts) AS b, min(path) AS p FROM k GROUP BY 1), "
    "x AS (SELECT *, array_to_string(a[1:len(list_filter(generate_series(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i]))], '/') AS prefix FROM g) "
    f"SELECT kind, n::BIGINT AS n_files, CASE WHEN prefix = '' THEN 'tests/' ELSE prefix || '/' END AS directory, {_COMMAND} AS command FROM x"
)
def local_recommendations(spark, folder):
    return coverage.recommendations(table(spark, folder, "file_info").where(P.is_test_file(F.col("path"))).select("path"))


# --- changes -----------------------------------------------------------------------------------------


@query(f"WITH {CTE['sy']}, c AS (SELECT DISTINCT path, 'modified' AS change_type FROM files WHERE line_count > 200 UNION SELECT path || '.old', 'deleted' FROM files WHERE line_count < 30 UNION SELECT path, 'added' FROM files WHERE line_count < 30) SELECT DISTINCT c.path, sy.name, sy.symbol_type, c.change_type, CASE WHEN starts_with(sy.name, '_') AND NOT starts_with(sy.name, '__') THEN false WHEN starts_with(sy.name, '__') AND ends_with(sy.name, '__') THEN true WHEN sy.symbol_type = 'method' THEN NOT starts_with(sy.name, '_') ELSE true END AS is_public FROM c JOIN sy ON sy.path = c.path")
def changed_symbols(spark, folder):
    f = table(spark, folder, "files")
    none = F.lit(None).cast("string")
    c = f.where("line_count > 200").select("path", none.alias("old_path"), F.lit("modified").alias("change_type")).unionByName(
        f.where("line_count < 30").select("path", F.concat("path", F.lit(".old")).alias("old_path"), F.lit("renamed").alias("change_type"))
    ).distinct()
    return change.changed_symbols(c, A.located_symbols(spark, folder))


@query(f"SELECT DISTINCT path, unnest(['tests/test_' || n, CASE WHEN d = '' THEN 'test_' || n ELSE d || '/test_' || n END, '__tests__/' || regexp_replace(n, '\\.[^.]*$', '') || '.test.' || list_last(string_split(n, '.'))]) AS test_path FROM (SELECT path, list_last(string_split(path, '/')) AS n, regexp_replace(path, '/?[^/]*$', '') AS d FROM file_info WHERE NOT {_test_sql('path', K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)})")
def synth_test_paths(spark, folder):
    return change.likely_tests(table(spark, folder, "file_info").select("path"))


@query(f"WITH {_HANDLERS} SELECT ep.* FROM ep JOIN (SELECT DISTINCT id, path AS p FROM files) f ON f.id = ep.file_id WHERE f.p IN (SELECT path FROM file_info WHERE is_sensitive) OR handler_name IN (SELECT trim(name) FROM symbols WHERE symbol_type = 'arrow_function' AND start_line < 20)")
def affected_endpoints(spark, folder):
    files = table(spark, folder, "files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path")).distinct()
    ends = _endpoints(spark, folder).withColumnRenamed("path", "route").join(files, "file_id")
    changed = table(spark, folder, "file_info").where("is_sensitive").select("path")
    s = table(spark, folder, "symbols").where("symbol_type = 'arrow_function' and start_line < 20").select(F.trim("name").alias("name"))
    return change.affected_endpoints(ends, changed, s).select("file_id", "handler_name", "method", F.col("route").alias("path"))


_SIG = {
    "public_api_change": "n_endpoints > 0", "high_fanout_symbol": "n_public >= 5", "workflow_entry_affected": "n_workflows > 0", "security_code_change": "security", "database_code_change": "database", "payment_code_change": "payment",
    "many_files_changed": "n_files > 10", "large_change_size": "n_lines > 500", "missing_test_changes": "source AND NOT tests",
}


@query("WITH " + CTE["ch"] + " SELECT commit_id, upper(left(change_type, 1)) || substr(change_type, 2) || ' ' || path || ' (+' || additions || ', -' || deletions || ')' AS line FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY path, change_type, additions, deletions) AS n FROM (SELECT DISTINCT * FROM ch)) WHERE n <= 20")
def change_evidence(spark, folder):
    return change.evidence(A.changes(spark, folder), "commit_id")
