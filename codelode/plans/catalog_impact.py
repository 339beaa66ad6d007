"""Queries of impact, correlation and evidence, each beside its SQL; see ``catalog`` for how they are registered.

Symbols are parts, with the file that their brand and type name; they call each
other as line items follow each other, and the changes of a commit are those of
its line items.  Test files, imports and definitions are those of ``file_info``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import predicates as P
from codelode.functions import text as X
from codelode.operators import evidence, graph, impact, ordering, search, targets
from codelode.operators import correlation as C
from codelode.plans import adapters as A
from codelode.plans import catalog as B
from codelode.plans.adapters import CTE
from codelode.plans.catalog import PATH, SEED, SQL, query
from codelode.sources import service
from codelode.sources.tables import table
from codelode.streaming import ingest

_PATH = "'src/' || lower(p_brand) || '/' || lower(p_type) || '.py'"
_PUBLIC = "NOT starts_with(name, '_')"
_PS = f"ps AS (SELECT p_partkey AS id, p_name AS name, {_PATH} AS path, 'function' AS symbol_type FROM part)"
_EP = f"ep AS (SELECT p_partkey AS symbol_id, 'GET' AS method, '/' || replace(p_name, ' ', '-') || '/' || p_partkey AS route, {_PATH} AS file_path FROM part WHERE p_size = 50)"
_PF = "pf AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM e JOIN ps a ON a.id = e.src JOIN ps b ON b.id = e.dst WHERE a.path <> b.path)"


def symbols(spark, folder):
    path = F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(".py"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), path.alias("path"), F.lit("function").alias("symbol_type"))


def endpoints(spark, folder):
    s = table(spark, folder, "part").where("p_size = 50").select(F.col("p_partkey").alias("id"), "p_name").join(symbols(spark, folder).select("id", "path"), "id")
    route = F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/"), F.col("id").cast("string"))
    return s.select(F.col("id").alias("symbol_id"), F.lit("GET").alias("method"), route.alias("route"), F.col("path").alias("file_path"))


def _seed(spark):
    return spark.range(SEED, SEED + 1).toDF("seed")


def _world(spark, folder):
    s, e = symbols(spark, folder), graph.fix(A.call_edges(spark, folder))
    return s, e, impact.file_imports(e.df, s)


# --- neighbours ------------------------------------------------------------------------------------


@query(f"SELECT {SEED}::BIGINT AS seed, 'calls' AS relation, dst::VARCHAR AS target FROM e WHERE src = {SEED} UNION SELECT {SEED}, 'imports', dst FROM pf WHERE src = (SELECT path FROM ps WHERE id = {SEED})", "e")
def symbol_dependencies(spark, folder):
    s, e, f = _world(spark, folder)
    return impact.dependencies(_seed(spark), e.df, f, s)


@query(f"SELECT {SEED}::BIGINT AS seed, 'callers' AS relation, src::VARCHAR AS target FROM e WHERE dst = {SEED} UNION SELECT {SEED}, 'imported_by', src FROM pf WHERE dst = (SELECT path FROM ps WHERE id = {SEED})", "e")
def symbol_dependents_union(spark, folder):
    s, e, f = _world(spark, folder)
    return impact.dependents(_seed(spark), e.df, f, s)


for _name in ("symbol_dependencies", "symbol_dependents_union"):
    SQL[_name] = SQL[_name].replace(CTE["e"] + " ", f"{CTE['e']}, {_PS}, {_PF} ", 1)


@query()
def file_imported_by(spark, folder):
    f = table(spark, folder, "file_info")
    imports = A.imports(spark, folder).select(F.col("repository_id").alias("analysis_run_id"), "path", "source")
    found = graph.resolve_imports(imports, f.select(F.col("repository_id").alias("analysis_run_id"), "path")).where("kind = 'file'")
    return found.select(F.col("analysis_run_id").alias("repository_id"), F.col("target").alias("path"), F.col("importer").alias("imported_by")).distinct()


SQL["file_imported_by"] = (
    f"WITH {CTE['im']}, i AS (SELECT DISTINCT repository_id AS run, path AS importer, source, regexp_replace(path, '/?[^/]*$', '') AS folder FROM im), "
    + B._IMPORTS[B._IMPORTS.index("b AS ("):]
    + "SELECT DISTINCT run AS repository_id, target AS path, importer AS imported_by FROM h"
)

_UPDOWN = (
    "{n} AS (SELECT * FROM (VALUES ('up'), ('down')) w(way), (SELECT {start} AS node, 0 AS depth) UNION SELECT {n}.way, CASE WHEN {n}.way = 'up' THEN {e}.src ELSE {e}.dst END, {n}.depth + 1 FROM {n} "
    "JOIN {e} ON CASE WHEN {n}.way = 'up' THEN {e}.dst ELSE {e}.src END = {n}.node WHERE {n}.depth < {d})"
)


@query()
def file_impact(spark, folder):
    s, e, f = _world(spark, folder)
    return impact.file_impact(PATH, e.df, f, s, 2)


SQL["file_impact"] = (
    f"WITH RECURSIVE {CTE['e']}, {_PS}, {_PF}, {_UPDOWN.format(n='r', e='pf', start=f'{PATH!r}', d=2)}, "
    f"own AS (SELECT id FROM ps WHERE path = '{PATH}'), a AS (SELECT CASE way WHEN 'up' THEN 0 ELSE 1 END AS rank, CASE way WHEN 'up' THEN 'dependent_file' ELSE 'dependency_file' END AS category, node AS entity, min(depth) AS depth FROM r WHERE node <> '{PATH}' GROUP BY ALL "
    "UNION ALL SELECT DISTINCT 2, 'direct_caller', src::VARCHAR, 1 FROM e WHERE dst IN (SELECT id FROM own) AND src NOT IN (SELECT id FROM own)) "
    "SELECT category, entity, depth::INTEGER AS depth FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rank, category, depth) AS n FROM a) WHERE n = 1"
)

_IMPACTS = (
    f"WITH RECURSIVE {CTE['e']}, {_PS}, {_EP}, q AS (SELECT symbol_id AS seed FROM ep WHERE %s), "
    "r AS (SELECT way, seed, seed AS node, 0 AS depth FROM q, (VALUES ('up'), ('down')) w(way) UNION SELECT r.way, r.seed, CASE WHEN r.way = 'up' THEN e.src ELSE e.dst END, r.depth + 1 FROM r JOIN e ON CASE WHEN r.way = 'up' THEN e.dst ELSE e.src END = r.node WHERE r.depth < %d), "
    "m AS (SELECT way, seed, node, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0), "
    "c AS (SELECT *, CASE WHEN depth = 1 THEN 'direct_' ELSE 'transitive_' END || CASE way WHEN 'up' THEN 'caller' ELSE 'callee' END AS category, CASE way WHEN 'up' THEN 0 ELSE 2 END + CASE WHEN depth = 1 THEN 0 ELSE 1 END AS rank FROM m), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY rank, category, depth) AS k FROM c) WHERE k = 1), "
    "i AS (SELECT seed, node, category, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY rank, depth, node) AS k FROM f) WHERE k <= 500) "
)


@query()
def endpoint_impact(spark, folder):
    """Impact of every endpoint, one step each way."""
    return impact.endpoint_impact(endpoints(spark, folder), A.call_edges(spark, folder), 1)


SQL["endpoint_impact"] = _IMPACTS % ("true", 1) + "SELECT method, route, node, category, depth::INTEGER AS depth FROM i JOIN ep ON ep.symbol_id = i.seed"


@query()
def impact_affected(spark, folder):
    """Files and endpoints that the impact of each endpoint's handler reaches."""
    s, ends = symbols(spark, folder), endpoints(spark, folder)
    return impact.affected(graph.impact(ends.select(F.col("symbol_id").alias("seed")), A.call_edges(spark, folder), 1), s, ends)


SQL["impact_affected"] = _IMPACTS % ("true", 1) + (
    ", x AS (SELECT seed, node FROM i UNION SELECT seed, seed FROM i) SELECT DISTINCT seed, 'file' AS kind, path AS value FROM x JOIN ps ON ps.id = x.node "
    "UNION SELECT DISTINCT seed, 'endpoint', method || ' ' || route FROM x JOIN ep ON ep.symbol_id = x.node"
)


@query()
def impact_bounded(spark, folder):
    return impact.bounded(_seed(spark), A.call_edges(spark, folder), 3)


SQL["impact_bounded"] = (
    f"WITH RECURSIVE {CTE['e']}, {_UPDOWN.format(n='r', e='e', start=f'{SEED}::BIGINT', d=3)}, m AS (SELECT way, node, min(depth) AS depth FROM r GROUP BY ALL), "
    "x AS (SELECT DISTINCT src, dst FROM m JOIN e ON CASE WHEN way = 'up' THEN dst ELSE src END = node WHERE depth < 3), "
    "k AS (SELECT (SELECT count(DISTINCT node) FROM m WHERE depth > 0) AS n, (SELECT count(*) FROM x) AS m) "
    f"SELECT {SEED}::BIGINT AS seed, least(n, 500)::BIGINT AS nodes, least(m, 1000)::BIGINT AS edges, CASE WHEN n > 500 THEN 'max_nodes_reached' WHEN m > 1000 THEN 'max_edges_reached' END AS reason FROM k"
)


@query()
def impact_by_category(spark, folder):
    found = graph.impact(_seed(spark), A.call_edges(spark, folder), 2)
    return impact.by_category(found, F.lpad(F.col("node").cast("string"), 9, "0"))


SQL["impact_by_category"] = _IMPACTS.replace("q AS (SELECT symbol_id AS seed FROM ep WHERE %s)", f"q AS (SELECT {SEED}::BIGINT AS seed)") % 2 + (
    ", t AS (SELECT *, lpad(node::VARCHAR, 9, '0') AS label, row_number() OVER (PARTITION BY seed, category ORDER BY lpad(node::VARCHAR, 9, '0')) AS k, count(*) OVER (PARTITION BY seed, category) AS n FROM i) "
    "SELECT seed, category, n::BIGINT AS n, string_agg(label, ', ' ORDER BY label) || CASE WHEN n > 20 THEN ' ... ' || (n - 20) || ' more' ELSE '' END AS listed FROM t WHERE k <= 20 GROUP BY seed, category, n"
)


@query()
def dependency_impact(spark, folder):
    """What surrounds the public symbols of one changed file."""
    changed = A.changes(spark, folder).where(F.col("path") == PATH).select(F.lit(PATH).alias("change_set"), "path")
    return impact.change_set_dependencies(changed, A.call_edges(spark, folder), symbols(spark, folder), "change_set")


SQL["dependency_impact"] = (
    f"WITH {CTE['e']}, {_PS}, o AS (SELECT id FROM ps WHERE path = '{PATH}' AND {_PUBLIC}), n AS (SELECT DISTINCT 'callers' AS kind, src AS node FROM e WHERE dst IN (SELECT id FROM o) UNION SELECT DISTINCT 'callees', dst FROM e WHERE src IN (SELECT id FROM o)), "
    "c AS (SELECT kind, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'files', count(DISTINCT path) FROM ps WHERE id IN (SELECT node FROM n) HAVING count(*) > 0) "
    f"SELECT '{PATH}' AS change_set, kind, least(n, 500)::BIGINT AS n, n >= 500 AS truncated FROM c"
)


@query()
def endpoint_workflow_edges(spark, folder):
    """Edges of the workflow of every endpoint, two calls deep."""
    return impact.endpoint_workflow(endpoints(spark, folder), A.call_edges(spark, folder), 2)[1]


SQL["endpoint_workflow_edges"] = (
    f"WITH RECURSIVE {CTE['e']}, {_EP}, r AS (SELECT symbol_id AS seed, symbol_id AS node, 0 AS depth FROM ep UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2), "
    "x AS (SELECT seed, src, dst, min(depth) + 1 AS depth FROM r JOIN e ON e.src = r.node WHERE depth < 2 GROUP BY ALL), y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, src, dst) AS k FROM x) WHERE k <= 199) "
    "SELECT method || ' ' || route AS endpoint, method || ' ' || route AS src, symbol_id::VARCHAR AS dst, 'handles' AS kind, 1::INTEGER AS depth FROM ep UNION ALL SELECT method || ' ' || route, src::VARCHAR, dst::VARCHAR, 'calls', (depth + 1)::INTEGER FROM y JOIN ep ON ep.symbol_id = y.seed"
)


@query()
def affected_workflows(spark, folder):
    """Workflows of the endpoints in the files of each commit, one call deep."""
    return impact.affected_workflows(endpoints(spark, folder), A.call_edges(spark, folder), symbols(spark, folder), A.changes(spark, folder), "commit_id", 1)


SQL["affected_workflows"] = (
    f"WITH {CTE['ch']}, {CTE['e']}, {_PS}, {_EP}, p AS (SELECT DISTINCT commit_id, path FROM ch), n AS (SELECT symbol_id AS seed, symbol_id AS node FROM ep UNION SELECT symbol_id, dst FROM ep JOIN e ON e.src = symbol_id), "
    "c AS (SELECT seed, path, count(*) AS k FROM n JOIN ps ON ps.id = n.node GROUP BY 1, 2), h AS (SELECT p.commit_id, method, route, symbol_id AS seed FROM p JOIN ep ON ep.file_path = p.path) "
    "SELECT h.commit_id, method, route, coalesce(sum(c.k) FILTER (WHERE p.path IS NOT NULL), 0)::BIGINT AS n_changed FROM h LEFT JOIN c ON c.seed = h.seed LEFT JOIN p ON p.commit_id = h.commit_id AND p.path = c.path GROUP BY 1, 2, 3"
)

_FACTS = (
    f"{CTE['ch']}, {_PS}, {_EP}, p AS (SELECT DISTINCT commit_id, path FROM ch), pu AS (SELECT path, count(*) AS k FROM ps WHERE {_PUBLIC} GROUP BY 1), en AS (SELECT file_path AS path, count(*) AS k FROM ep GROUP BY 1), "
    "n AS (SELECT commit_id, coalesce(sum(en.k), 0)::BIGINT AS n_endpoints, coalesce(sum(pu.k), 0)::BIGINT AS n_public, coalesce(sum(en.k), 0)::BIGINT AS n_workflows FROM p LEFT JOIN pu USING (path) LEFT JOIN en USING (path) GROUP BY 1), "
    f"g AS (SELECT commit_id, any_value(n_endpoints) AS n_endpoints, any_value(n_public) AS n_public, any_value(n_workflows) AS n_workflows, bool_or({B._any('lower(path)', K.SECURITY_PATHS)}) AS security, bool_or({B._any('lower(path)', K.DATABASE_PATHS)}) AS database, "
    f"bool_or({B._any('lower(path)', K.PAYMENT_PATHS)}) AS payment, count(DISTINCT path) AS n_files, sum(additions + deletions) AS n_lines, bool_or(NOT {B._any('lower(path)', K.NON_SOURCE_PATHS)}) AS source, bool_or({B._test_sql('path', K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)}) AS tests, "
    f"count(DISTINCT path) FILTER (WHERE {B._test_sql('path', K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)}) AS n_tests FROM ch JOIN n USING (commit_id) GROUP BY 1), "
    "s AS (SELECT *, least(" + " + ".join(f"CASE WHEN {c} THEN {K.RISK_WEIGHTS[k]} ELSE 0 END" for k, c in B._SIG.items()) + ", 100)::INTEGER AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in B._SIG.items()) + "], lambda x: x IS NOT NULL), ',') AS signals FROM g) "
)
_LEVEL = "CASE WHEN score >= 86 THEN 'critical' WHEN score >= 61 THEN 'high' WHEN score >= 31 THEN 'medium' ELSE 'low' END AS level"


def _impact_of_changes(spark, folder):
    return impact.change_impact(A.changes(spark, folder).withColumn("language", F.lit("Python")), symbols(spark, folder), endpoints(spark, folder), "commit_id")


@query(f"WITH {_FACTS} SELECT commit_id, n_files::BIGINT AS n_files, n_tests::BIGINT AS n_tests, n_endpoints, n_public, n_workflows, score, {_LEVEL}, signals FROM s")
def change_impact(spark, folder):
    return _impact_of_changes(spark, folder)


@query(f"WITH {_FACTS} SELECT commit_id, score, {_LEVEL}, signals FROM s")
def risk_score(spark, folder):
    return _impact_of_changes(spark, folder).select("commit_id", "score", "level", "signals")


@query(f"WITH {_FACTS}, l AS (SELECT commit_id, CASE WHEN n_endpoints > 0 OR n_public + n_endpoints > 20 THEN 'high' WHEN n_public + n_endpoints = 0 THEN 'low' ELSE 'medium' END AS risk, list_filter(["
       + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in impact.PLAN) + "], lambda x: x IS NOT NULL) AS steps FROM s) SELECT commit_id, risk, (k - 1)::INTEGER AS position, steps[k] AS step FROM (SELECT *, unnest(generate_series(1, len(steps))) AS k FROM l)")
def implementation_plan(spark, folder):
    return impact.implementation_plan(_impact_of_changes(spark, folder), "commit_id")


# --- tests and changes -----------------------------------------------------------------------------


def _listing(spark, folder):
    return table(spark, folder, "file_info").select("repository_id", "path").distinct()


def _test_files(spark, folder):
    return _listing(spark, folder).where(P.is_test_file(F.col("path")))


def _changed_files(spark, folder):
    """The change set: source files of at least forty lines."""
    return table(spark, folder, "file_info").where(F.col("lines") >= 40).where(~P.is_test_file(F.col("path"))).select("repository_id", "path").distinct()


_TEST = B._test_sql("path", K.TEST_DIRS, K.TEST_NAMES)
_SETS = (
    f"fl AS (SELECT DISTINCT repository_id, path FROM file_info), tf AS (SELECT * FROM fl WHERE {_TEST}), cf AS (SELECT DISTINCT repository_id, path FROM file_info WHERE lines >= 40 AND NOT {_TEST}), "
    "ms AS (SELECT repository_id, path, imported_names, CASE WHEN contains(b, '/') THEN b ELSE replace(b, '.', '/') END AS stem FROM (SELECT *, regexp_replace(source, '^[./@]+', '') AS b FROM im))"
)


def _imported(files: str) -> str:
    return f"SELECT DISTINCT m.repository_id, m.path, m.imported_names, f.path AS target FROM ms m JOIN {files} f ON f.repository_id = m.repository_id AND (f.path = m.stem || '.py' OR ends_with(f.path, '/' || m.stem || '.py') OR f.path = m.stem || '.ts' OR ends_with(f.path, '/' || m.stem || '.ts') OR f.path = m.stem || '.js' OR ends_with(f.path, '/' || m.stem || '.js')) WHERE m.stem <> ''"


_NAMES = "list_filter(list_transform(string_split(imported_names, ','), lambda x: trim(x)), lambda x: x <> '')"
_BARE = "replace(regexp_replace(list_last(string_split(%s, '/')), '\\.[^.]*$', ''), 'test_', '')"
_FAILED = "ft AS (SELECT repository_id, repository_id || ':' || path AS test_id, list_last(string_split(path, '/')) AS full_name, path FROM tf)"
_CORRELATED = (
    f"WITH {CTE['im']}, {CTE['df']}, {_SETS}, {_FAILED}, di AS ({_imported('cf')}), d AS (SELECT ft.*, di.target, di.imported_names FROM ft JOIN di USING (repository_id, path)), "
    f"ds AS (SELECT DISTINCT test_id, target || '::' || df.name AS s FROM d JOIN df ON df.repository_id = d.repository_id AND df.path = d.target WHERE len({_NAMES}) = 0 OR list_contains({_NAMES}, df.name)), "
    "x AS (SELECT test_id, full_name, 'direct_import' AS correlation_type, 'high' AS confidence, string_agg(DISTINCT target, ',' ORDER BY target) AS changed_files FROM d GROUP BY 1, 2), "
    f"y AS (SELECT test_id, full_name, 'module_sibling' AS correlation_type, 'medium' AS confidence, string_agg(DISTINCT cf.path, ',' ORDER BY cf.path) AS changed_files FROM ft JOIN cf ON cf.repository_id = ft.repository_id AND {_BARE % 'cf.path'} = {_BARE % 'ft.path'} WHERE test_id NOT IN (SELECT test_id FROM x) GROUP BY 1, 2), "
    "z AS (SELECT test_id, string_agg(s, ',' ORDER BY s) AS changed_symbols FROM ds GROUP BY 1), fc AS (SELECT x.*, coalesce(changed_symbols, '') AS changed_symbols FROM x LEFT JOIN z USING (test_id) UNION ALL SELECT *, '' FROM y) "
)


def _failed_tests(spark, folder):
    """A failed test for each test file; its report names the file of long paths, the suite is a path or a dotted module."""
    t = _test_files(spark, folder)
    dotted = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    plain = F.col("path").rlike(r"^[^.]*\.py$") & F.col("path").contains("/")
    return t.select(
        "repository_id", F.concat_ws(":", "repository_id", "path").alias("test_id"), X.filename(F.col("path")).alias("full_name"),
        F.when(plain, dotted).otherwise(F.col("path")).alias("suite_name"),
        F.when(~F.col("path").contains("/"), F.to_json(F.struct(F.col("path").alias("file")))).alias("metadata"),
    )


def _correlations(spark, folder):
    definitions = A.definitions(spark, folder)
    return C.failure_correlations(_failed_tests(spark, folder), _listing(spark, folder), A.imports(spark, folder), _changed_files(spark, folder), definitions)


@query(_CORRELATED + "SELECT * FROM fc")
def failure_correlation(spark, folder):
    return _correlations(spark, folder)


@query(_CORRELATED + ", k AS (SELECT CASE WHEN contains(full_name, '.ts') THEN 'regression' ELSE 'fixed' END AS trend_type, full_name FROM ft WHERE contains(full_name, '.ts') OR contains(full_name, '.js')) "
       "SELECT ft.full_name, ft.test_id, c.correlation_type, t.trends FROM ft LEFT JOIN (SELECT test_id, min(correlation_type) AS correlation_type FROM fc GROUP BY 1) c USING (test_id) LEFT JOIN (SELECT full_name, string_agg(DISTINCT trend_type, ',' ORDER BY trend_type) AS trends FROM k GROUP BY 1) t USING (full_name)")
def failure_overview(spark, folder):
    failed = _failed_tests(spark, folder).select("test_id", "full_name")
    kind = F.when(F.col("full_name").contains(".ts"), "regression").otherwise("fixed")
    trends = failed.where(F.col("full_name").contains(".ts") | F.col("full_name").contains(".js")).select("full_name", kind.alias("trend_type"))
    return C.failure_overview(failed, _correlations(spark, folder), trends)


@query(f"WITH {CTE['im']}, {_SETS}, sf AS (SELECT * FROM fl WHERE NOT {_TEST}), d AS ({_imported('sf')}), r AS (SELECT tf.repository_id, tf.path, d.target, 0 AS rank FROM tf JOIN d USING (repository_id, path) WHERE tf.path <> d.target "
       f"UNION SELECT tf.repository_id, tf.path, sf.path, 1 FROM tf JOIN sf ON sf.repository_id = tf.repository_id AND {B._stem('sf.path')} = {B._stem('tf.path')}) "
       "SELECT repository_id, path, target, CASE min(rank) WHEN 0 THEN 'direct_import' ELSE 'sibling_module' END AS relationship, CASE min(rank) WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM r GROUP BY 1, 2, 3")
def test_to_sources(spark, folder):
    sources = _listing(spark, folder).where(~P.is_test_file(F.col("path")))
    return C.sources_of_tests(_test_files(spark, folder), sources, A.imports(spark, folder))


_AFFECTED = (
    f"WITH {CTE['im']}, {CTE['df']}, {_SETS}, k AS (SELECT * FROM tf WHERE (repository_id, path) NOT IN (SELECT (repository_id, path) FROM cf)), di AS ({_imported('cf')}), u AS (SELECT k.*, di.target, di.imported_names FROM k JOIN di USING (repository_id, path)), "
    f"r AS (SELECT DISTINCT u.repository_id, u.path, target, 0 AS rank FROM u JOIN df ON df.repository_id = u.repository_id AND df.path = u.target WHERE list_contains({_NAMES}, df.name) UNION SELECT DISTINCT repository_id, path, target, 1 FROM u "
    f"UNION SELECT DISTINCT k.repository_id, k.path, cf.path, 2 FROM k JOIN cf ON cf.repository_id = k.repository_id AND {B._stem('cf.path')} = {B._stem('k.path')}), "
    "c AS (SELECT repository_id, path, rank, count(*) AS n FROM r GROUP BY ALL), af AS (SELECT repository_id, path, CASE rank WHEN 0 THEN 'direct_import' WHEN 1 THEN 'indirect_import' ELSE 'sibling_module' END AS relationship, CASE rank WHEN 0 THEN 'high' ELSE 'medium' END AS confidence, n::BIGINT AS n_targets FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, path ORDER BY rank) AS o FROM c) WHERE o = 1) "
)


@query(_AFFECTED + "SELECT * FROM af")
def affected_tests_ranked(spark, folder):
    return C.affected_tests(_test_files(spark, folder), A.imports(spark, folder), _changed_files(spark, folder), A.definitions(spark, folder))


@query(_AFFECTED + ", n AS (SELECT repository_id, confidence, count(*) AS n FROM af GROUP BY 1, 2) SELECT repository_id, sum(n)::BIGINT AS n, string_agg(confidence || ': ' || n, ', ' ORDER BY confidence || ': ' || n) AS text FROM n GROUP BY 1")
def evidence_counters(spark, folder):
    return evidence.counters(affected_tests_ranked(spark, folder), ["repository_id"], "confidence")


# --- evidence --------------------------------------------------------------------------------------


@query(f"{_EP}, r AS (SELECT DISTINCT symbol_id AS seed, 'callers' AS relation, src AS node FROM ep JOIN e ON e.dst = symbol_id UNION SELECT DISTINCT symbol_id, 'callees', dst FROM ep JOIN e ON e.src = symbol_id) "
       "SELECT seed, relation, node, n > 10 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed, relation ORDER BY node) AS k, count(*) OVER (PARTITION BY seed, relation) AS n FROM r) WHERE k <= 10")
def graph_evidence(spark, folder):
    return evidence.graph_evidence(endpoints(spark, folder).select(F.col("symbol_id").alias("seed")), A.call_edges(spark, folder))


SQL["graph_evidence"] = f"WITH {CTE['e']}, " + SQL["graph_evidence"]


@query("SELECT dst, count(DISTINCT src)::BIGINT AS n_callers FROM e GROUP BY 1", "e")
def caller_counts(spark, folder):
    """Distinct sources of the edges into each node; call edges are distinct already."""
    return A.call_edges(spark, folder).groupBy("dst").agg(F.count("src").alias("n_callers"))


@query(f"WITH {CTE['sy']}, k AS (SELECT DISTINCT path || ':' || name || ':' || symbol_type AS symbol_key FROM sy UNION SELECT DISTINCT path || ':' || name || ':none' FROM sy), m AS (SELECT path || ':' || name || ':' || symbol_type AS symbol_key, min(id) AS symbol_id FROM sy GROUP BY 1) SELECT symbol_key, symbol_id FROM k LEFT JOIN m USING (symbol_key)")
def composite_key_lookup(spark, folder):
    s = A.located_symbols(spark, folder)
    keys = s.select(F.concat_ws(":", "path", "name", "symbol_type").alias("symbol_key")).unionByName(s.select(F.concat_ws(":", "path", "name", F.lit("none")).alias("symbol_key"))).distinct()
    return evidence.composite_lookup(keys, s)


@query(f"WITH {B._ANSWERS}, ev AS (SELECT answer_id, i::INTEGER AS number, answer_id * 10 + i AS evidence_id FROM a, generate_series(1, 4) g(i)), "
       "c AS (SELECT answer_id, (i - 1)::INTEGER AS position, u[i] AS n FROM (SELECT answer_id, n_evidence, u, unnest(generate_series(1, len(u))) AS i FROM (SELECT answer_id, n_evidence, list_transform(regexp_extract_all(answer, '\\[Evidence (\\d+)\\]', 1), lambda x: x::INTEGER) AS l, list_filter(l, lambda x, k: list_position(l, x) = k) AS u FROM a)) WHERE u[i] BETWEEN 1 AND n_evidence) "
       "SELECT c.answer_id, c.n AS evidence, c.position, ev.evidence_id FROM c JOIN ev ON ev.answer_id = c.answer_id AND ev.number = c.n")
def cited_evidence(spark, folder):
    a = B._answers(spark, folder)
    numbers = a.select("answer_id", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("number"))
    return evidence.cited_evidence(a, numbers.withColumn("evidence_id", F.col("answer_id") * 10 + F.col("number")))


@query("SELECT DISTINCT k.analysis_run_id, k.name, f.id AS symbol_id FROM (SELECT DISTINCT analysis_run_id, trim(name) AS name FROM symbols) k LEFT JOIN (SELECT analysis_run_id, trim(name) AS name, arg_min(id, (start_line, id)) AS id FROM symbols GROUP BY 1, 2) f ON f.analysis_run_id = k.analysis_run_id AND f.name = k.name")
def first_symbol_lookup(spark, folder):
    s = table(spark, folder, "symbols").withColumn("name", F.trim("name"))
    return evidence.first_symbols(s.select("analysis_run_id", "name").distinct(), s)


@query(f"WITH {_PS}, {_EP}, {CTE['im']}, {B._HANDLERS} SELECT DISTINCT id AS node_id, 'symbol' AS node_type, trim(name) AS label FROM symbols UNION SELECT DISTINCT id, 'file', path FROM files UNION SELECT DISTINCT symbol_id::VARCHAR, 'endpoint', method || ' ' || route FROM ep UNION SELECT DISTINCT 'external', 'external_module', source FROM im WHERE NOT starts_with(source, '.')".replace(f", {B._HANDLERS}", ""))
def graph_nodes(spark, folder):
    s = table(spark, folder, "symbols").select("id", F.trim("name").alias("name"))
    f = table(spark, folder, "files").select("id", "path")
    m = A.imports(spark, folder).where(~F.startswith("source", F.lit("."))).select("source")
    return evidence.nodes(s, f, endpoints(spark, folder).withColumnRenamed("symbol_id", "id"), m)


@query("SELECT analysis_run_id, id, path, language, n_files::BIGINT AS n_files, n_files > 100 AS is_cut FROM (SELECT *, row_number() OVER (PARTITION BY analysis_run_id ORDER BY language IS NULL, path, id) AS k, count(*) OVER (PARTITION BY analysis_run_id) AS n_files FROM (SELECT DISTINCT analysis_run_id, id, path, language FROM files)) WHERE k <= 100")
def file_preview(spark, folder):
    return evidence.file_preview(table(spark, folder, "files").select("analysis_run_id", "id", "path", "language").distinct(), ["analysis_run_id"])


@query("SELECT status, count(*)::BIGINT AS n_runs, round(sum((epoch_us(completed_at) - epoch_us(started_at)) / 1e6), 2) AS seconds FROM (SELECT DISTINCT id, status, started_at, completed_at FROM analysis_runs) WHERE started_at IS NOT NULL AND completed_at IS NOT NULL GROUP BY 1")
def stage_seconds(spark, folder):
    return evidence.stage_seconds(table(spark, folder, "analysis_runs").select("id", "status", "started_at", "completed_at").distinct(), ["status"])


@query("SELECT DISTINCT id, least(greatest(coalesce(progress, 0), 0), 100)::INTEGER AS progress, left(regexp_replace(string_split(error_message, chr(10))[1], '(/[A-Za-z0-9_.-]+){2,}', '<path>', 'g'), 200) AS message FROM (SELECT *, CASE WHEN error_message IS NOT NULL THEN error_message || ' in /srv/work/' || id || '.log' END AS m FROM analysis_runs) q".replace("string_split(error_message,", "string_split(m,"))
def safe_messages(spark, folder):
    text = F.concat("error_message", F.lit(" in /srv/work/"), "id", F.lit(".log"))
    return table(spark, folder, "analysis_runs").select("id", X.progress(F.col("progress")).alias("progress"), evidence.safe_message(text).alias("message")).distinct()


@query("SELECT doc_id, CASE WHEN trim(text) <> '' THEN left(text, 2000) END AS input FROM documents")
def embedding_input(spark, folder):
    return table(spark, folder, "documents").select("doc_id", evidence.embedding_input(F.col("text")).alias("input"))


@query("SELECT repository_id, source AS evidence_type, path AS file_path, doc_id AS evidence_id, n_chars AS score FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, source, path ORDER BY n_chars DESC NULLS LAST, doc_id) AS k FROM documents) WHERE k = 1")
def distinct_evidence(spark, folder):
    none = F.lit(None).cast("string")
    d = table(spark, folder, "documents").select(
        "repository_id", F.col("source").alias("evidence_type"), F.col("path").alias("file_path"), F.col("doc_id").alias("evidence_id"), F.col("n_chars").alias("score"),
        none.alias("start_line"), none.alias("end_line"), none.alias("symbol_name"), none.alias("method_path"),
    )
    return search.distinct_evidence(d).select("repository_id", "evidence_type", "file_path", "evidence_id", "score")


@query("SELECT commit_id, string_agg('[Evidence ' || k || '] ' || change_type || chr(10) || path, chr(10) || chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY path, change_type, additions, deletions) AS k FROM (SELECT DISTINCT * FROM ch)) WHERE k <= 10 GROUP BY 1", "ch")
def change_prompts(spark, folder):
    c = A.changes(spark, folder).distinct().withColumn("content", F.col("path"))
    return evidence.evidence_prompt(c, ["commit_id"], F.col("change_type"), F.col("path"), F.col("change_type"), F.col("additions"), F.col("deletions"))


@query()
def rag_context(spark, folder):
    return evidence.context(A.chunks(spark, folder), B.WORDS, B._VECTOR).select("chunk_id", "content", "final_score", "source")


SQL["rag_context"] = SQL["rag_budget"].replace("SELECT chunk_id, final_score, CASE WHEN", "SELECT chunk_id, final_score, source, CASE WHEN").replace(
    "SELECT chunk_id, final_score, running::BIGINT AS running FROM r", "SELECT chunk_id, content, final_score, source FROM r"
)


# --- pages and limits ------------------------------------------------------------------------------


@query("SELECT id, full_name, stars FROM (SELECT DISTINCT id, full_name, stars FROM repositories) ORDER BY stars DESC NULLS LAST, full_name, id LIMIT 20")
def repository_page(spark, folder):
    r = table(spark, folder, "repositories").select("id", "full_name", "stars").distinct()
    return ordering.page(r, F.desc_nulls_last("stars"), F.col("full_name"), F.col("id"))


@query("SELECT test_run_id, imported_at, count(*)::BIGINT AS n FROM tc GROUP BY 1, 2 ORDER BY imported_at DESC, test_run_id LIMIT 20", "tc")
def test_run_page(spark, folder):
    r = A.test_cases(spark, folder).groupBy("test_run_id", "imported_at").agg(F.count(F.lit(1)).alias("n"))
    return ordering.page(r, F.desc("imported_at"), F.col("test_run_id"))


@query("SELECT full_name, outcome FROM tc WHERE test_run_id = '2024-01-30' ORDER BY full_name LIMIT 100", "tc")
def run_cases_page(spark, folder):
    c = A.test_cases(spark, folder).where("test_run_id = '2024-01-30'").select("full_name", "outcome")
    return ordering.page(c, F.col("full_name"), size=100)


@query(f"SELECT name, score FROM ({SQL['name_similarity']}) WHERE score >= 0.5 ORDER BY score DESC, name LIMIT 10")
def partial_matches(spark, folder):
    """The most similar names; all are scored before the limit."""
    n = table(spark, folder, "symbols").select(F.trim("name").alias("name")).distinct()
    scored = n.select("name", F.round(X.name_similarity(F.lit("renderPage"), F.col("name")), 6).alias("score")).where("score >= 0.5")
    return ordering.page(scored, F.desc("score"), F.col("name"), size=10)


@query()
def ambiguous_candidates(spark, folder):
    """The five best targets of each question that fits several; tokens and patterns go beyond the SQL of the check."""
    q = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    ends = B._endpoints(spark, folder).withColumn("id", F.sha2(F.concat("file_id", "path"), 256))
    found = targets.candidates(q, A.located_symbols(spark, folder), table(spark, folder, "files").select("id", "path").distinct(), ends)
    return ordering.top_of(found, ["question_id"], 5, F.desc("score"), F.col("kind"), F.col("target_id"))


# --- metadata --------------------------------------------------------------------------------------


@query("SELECT DISTINCT id, owner, name, full_name, coalesce(description, '') AS description, coalesce(default_branch, 'main') AS default_branch, language, coalesce(stars, 0)::INTEGER AS stars, 0::INTEGER AS forks, 'public' AS visibility, github_url AS url, 0::INTEGER AS open_issues FROM repositories")
def repository_metadata(spark, folder):
    """Repositories written as the JSON of a service and read again with their defaults."""
    r = table(spark, folder, "repositories").distinct()
    body = F.to_json(F.struct(
        F.col("id"), F.struct(F.col("owner").alias("login")).alias("owner"), "name", "full_name", "description", "default_branch", "language",
        F.col("stars").alias("stargazers_count"), F.col("github_url").alias("html_url"),
    ))
    return service.repositories(r.select(body.alias("body"))).distinct()


@query("SELECT commit_id AS number, 'Change of ' || path AS title, CASE change_type WHEN 'added' THEN 'open' ELSE 'closed' END AS state, change_type = 'deleted' AS merged, path AS head, 'main' AS base, additions, deletions, 0::INTEGER AS comments FROM (SELECT DISTINCT commit_id, path, change_type, additions, deletions FROM ch)", "ch")
def pull_request_metadata(spark, folder):
    c = A.changes(spark, folder).distinct()
    body = F.to_json(F.struct(
        F.col("commit_id").alias("number"), F.concat(F.lit("Change of "), "path").alias("title"), F.when(F.col("change_type") == "added", "open").otherwise("closed").alias("state"),
        F.when(F.col("change_type") == "deleted", True).alias("merged"), F.struct(F.col("path").alias("ref")).alias("head"), F.struct(F.lit("main").alias("ref")).alias("base"), "additions", "deletions",
    ))
    return service.pull_requests(c.select(body.alias("body"))).select("number", "title", "state", "merged", "head", "base", "additions", "deletions", "comments")


# --- windows of time -------------------------------------------------------------------------------


@query("SELECT w AS window_start, event_type AS outcome, count(*)::BIGINT AS n FROM (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours' * k FOR k IN [0, 1, 2, 3]]) AS w FROM events) GROUP BY 1, 2")
def outcome_sliding(spark, folder):
    e = table(spark, folder, "events").select("ts", F.col("event_type").alias("outcome"))
    return ingest.outcome_sliding(e, width="1 day", slide="6 hours")


@query("SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*)::BIGINT AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' > ts THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s")
def user_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events").select("ts", "user_id"), "user_id", "30 minutes")

