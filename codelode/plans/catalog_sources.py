"""Queries of parsers and report sources.

Reports, logs and workflow files are written from the tables and read again, so
SQL can say what has to come back; what the parsers find in the stored sources
it cannot express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import constants as K
from codelode.functions import text as X
from codelode.operators import graph, search
from codelode.plans import adapters as A
from codelode.plans.adapters import CTE
from codelode.plans.catalog import _test_sql
from codelode.sources import ci, gitlog, reports, source_code
from codelode.sources.tables import table

SQL: dict[str, str] = {}


def _analysed(spark: SparkSession, folder: str) -> DataFrame:
    return source_code.analyse(table(spark, folder, "file_info"))


def source_symbols(spark: SparkSession, folder: str) -> DataFrame:
    rows = _analysed(spark, folder).where("kind = 'symbol'")
    return rows.select("repository_id", "path", "name", F.col("detail").alias("symbol_type"), F.col("owner").alias("class_name"), "start_line", "end_line")


def source_imports(spark: SparkSession, folder: str) -> DataFrame:
    rows = _analysed(spark, folder).where("kind = 'import'")
    return rows.select("repository_id", "path", F.col("name").alias("source"), F.col("detail").alias("imported_names"), F.col("start_line").alias("line_number"))


def source_calls(spark: SparkSession, folder: str) -> DataFrame:
    rows = _analysed(spark, folder).where("kind = 'call'")
    return rows.select("repository_id", "path", F.col("owner").alias("caller_name"), F.col("name").alias("callee_name"), F.col("start_line").alias("line_number"))


def source_call_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in the stored sources, resolved against all symbols of their repository."""
    run, file_id = F.col("repository_id").alias("analysis_run_id"), F.col("path").alias("file_id")
    calls = source_calls(spark, folder).select("caller_name", "callee_name", run, file_id, "line_number")
    symbol_id = F.sha2(F.to_json(F.struct("repository_id", "path", "symbol_type", "class_name", "name", "start_line")), 256).alias("id")
    return graph.resolve_calls(calls, source_symbols(spark, folder).select(symbol_id, "name", run, file_id).distinct())


def analysis_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _analysed(spark, folder).groupBy("kind", F.when(F.col("kind") == "symbol", F.col("detail")).alias("symbol_type")).agg(F.count(F.lit(1)).alias("n"))


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes of a service written for each repository, so that every framework occurs."""
    text = F.concat(F.lit("@app.get('/"), F.lower("name"), F.lit("')\ndef read(): pass\n\n@bp.route('/x', methods=['POST', 'PUT'])\ndef write(): pass\n"))
    r = table(spark, folder, "repositories").select(F.col("id").alias("repository_id"), "name").distinct()
    py = r.select("repository_id", F.lit("api.py").alias("path"), text.alias("content"))
    js = r.select("repository_id", F.lit("api.js").alias("path"), F.concat(F.lit("router.post('/"), F.lower("name"), F.lit("', check, handler);\n")).alias("content"))
    rows = source_code.analyse(py.unionByName(js)).where("kind = 'route'")
    return rows.select("repository_id", "path", F.col("name").alias("handler"), F.col("detail").alias("route"), F.col("owner").alias("framework"))


def _junit_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of the test cases as JUnit texts."""
    ms, n = F.col("duration_ms"), F.lit(1000)
    time = F.concat(F.floor(ms / n).cast("string"), F.lit("."), F.lpad((ms % n).cast("string"), 3, "0"), F.lit("5"))
    body = F.when(F.col("outcome") == "failed", F.concat(F.lit('<failure message="'), "full_name", F.lit(' &amp; more" type="AssertionError">line 1</failure>'))).when(F.col("outcome") == "skipped", "<skipped/>").otherwise("")
    case = F.concat(F.lit('<testcase name="'), "full_name", F.lit('" classname="all" time="'), time, F.lit('">'), body, F.lit("</testcase>"))
    cases = A.test_cases(spark, folder).groupBy(F.col("test_run_id").alias("report_id")).agg(F.array_join(F.collect_list(case), "").alias("cases"))
    return cases.select("report_id", F.concat(F.lit('<?xml version="1.0"?><testsuites><testsuite name="'), "report_id", F.lit('">'), "cases", F.lit("</testsuite></testsuites>")).alias("content"))


def junit_parse(spark: SparkSession, folder: str) -> DataFrame:
    return reports.junit_cases(_junit_reports(spark, folder))


_FAILED = "CASE WHEN outcome = 'failed' THEN %s END"
SQL["junit_parse"] = (
    f"WITH {CTE['tc']} SELECT test_run_id AS report_id, test_run_id AS suite_name, full_name AS test_name, 'all' AS class_name, 'all.' || full_name AS full_name, outcome, duration_ms, "
    f"{_FAILED % chr(39).join(['full_name || ', ' & more', ''])} AS failure_message, {_FAILED % repr('AssertionError')} AS failure_type, {_FAILED % repr('line 1')} AS failure_stacktrace FROM tc"
)


def json_report_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of the test cases as JSON texts, passed cases without outcome's case and skipped ones without duration."""
    case = F.struct(
        F.col("test_run_id").alias("suite_name"), F.col("full_name").alias("test_name"), F.upper("outcome").alias("outcome"),
        F.when(F.col("outcome") != "skipped", F.col("duration_ms")).alias("duration_ms"), F.when(F.col("outcome") == "failed", F.col("full_name")).alias("failure_message"),
    )
    runs = A.test_cases(spark, folder).groupBy(F.col("test_run_id").alias("report_id")).agg(F.to_json(F.struct(F.collect_list(case).alias("test_cases"))).alias("content"))
    return reports.json_cases(runs)


SQL["json_report_parse"] = (
    f"WITH {CTE['tc']} SELECT test_run_id AS report_id, test_run_id AS suite_name, full_name AS test_name, NULL::VARCHAR AS class_name, test_run_id || '.' || full_name AS full_name, outcome, "
    f"CASE WHEN outcome = 'skipped' THEN 0 ELSE duration_ms END AS duration_ms, {_FAILED % 'full_name'} AS failure_message, NULL::VARCHAR AS failure_type, NULL::VARCHAR AS failure_stacktrace FROM tc"
)


def gitlog_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Commits written as a log and read again."""
    c = table(spark, folder, "commits")
    seconds = F.unix_seconds(F.col("committed_at").cast("timestamp")).cast("string")
    line = F.concat_ws(gitlog.FIELD, "commit_hash", "author_name", "author_email", seconds, F.coalesce("parent_hashes", F.lit("")), X.subject(F.col("commit_message")), F.lit(""))
    logs = c.groupBy("repository_id", F.to_date("committed_at").alias("day")).agg(F.concat_ws(gitlog.COMMIT, F.collect_list(line)).alias("content"))
    return gitlog.commits(logs)


SQL["gitlog_parse"] = (
    "SELECT repository_id, trim(commit_hash) AS commit_hash, trim(author_name) AS author_name, trim(author_email) AS author_email, trim(string_split(commit_message, chr(10))[1]) AS commit_message, "
    "date_trunc('second', committed_at) AS committed_at, replace(trim(coalesce(parent_hashes, '')), ' ', ',') AS parent_hashes FROM commits "
    "WHERE commit_hash IS NOT NULL AND author_name IS NOT NULL AND author_email IS NOT NULL AND committed_at IS NOT NULL AND commit_message IS NOT NULL"
)


def ci_commands(spark: SparkSession, folder: str) -> DataFrame:
    """A workflow file for each repository, with the command of its language, and how relevant it is to the listed files."""
    language = F.lower("language")
    command = F.when(language == "python", "python -m pytest tests/").when(language.isin("javascript", "typescript"), "npm test -- --ci").otherwise("go test ./...")
    text = F.concat(F.lit("on:\n  push:\njobs:\n  unit:\n    steps:\n      - run: "), command, F.lit("\n      # run: npm test\n"))
    r = table(spark, folder, "repositories").groupBy(F.col("id").alias("repository_id")).agg(F.max("language").alias("language"))
    jobs = ci.ci_jobs(r.select("repository_id", F.lit(".github/workflows/ci.yml").alias("path"), text.alias("content")))
    changed = table(spark, folder, "file_info").select("repository_id", "path", "language")
    return ci.relevant(jobs, changed).join(jobs.select("repository_id", "job", F.array_join("commands", ";").alias("commands")), ["repository_id", "job"])


_CI = "CASE WHEN lower(l) = 'python' THEN 'python -m pytest tests/' WHEN lower(l) IN ('javascript', 'typescript') THEN 'npm test -- --ci' ELSE 'go test ./...' END"
SQL["ci_commands"] = (
    f"WITH r AS (SELECT id AS repository_id, max(language) AS l FROM repositories GROUP BY 1), f AS (SELECT repository_id, bool_or({_test_sql('path', K.CHANGE_TEST_DIRS, K.CHANGE_TEST_NAMES)}) AS t, list(DISTINCT language) AS g FROM file_info GROUP BY 1), "
    f"x AS (SELECT *, {_CI} AS c FROM r JOIN f USING (repository_id)) SELECT repository_id, '.github/workflows/ci.yml' AS path, 'unit' AS job, '- run: ' || c AS commands, "
    "CASE WHEN t OR contains(c, 'pytest') AND list_contains(g, 'Python') OR contains(c, 'npm') AND list_has_any(g, ['JavaScript', 'TypeScript']) OR contains(c, 'go test') AND list_contains(g, 'Go') THEN 'high' ELSE 'medium' END AS relevance FROM x"
)
SQL["routes"] = (
    "WITH r AS (SELECT DISTINCT id AS repository_id, lower(name) AS n FROM repositories) SELECT repository_id, 'api.py' AS path, 'read' AS handler, 'GET /' || n AS route, 'fastapi' AS framework FROM r "
    "UNION ALL SELECT repository_id, 'api.py', 'write', unnest(['POST /x', 'PUT /x']), 'flask' FROM r UNION ALL SELECT repository_id, 'api.js', 'handler', 'POST /' || n, 'express' FROM r"
)


def section_parse(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    answer = F.concat(F.lit("## Summary\n"), F.col("text"), F.lit("\n## Risk\nlow\n```json\n{\"a\": 1}\n```\n"))
    return d.select("doc_id", X.section(answer, "Risk").alias("risk"), X.fenced_json(answer).alias("json_text"))


SQL["section_parse"] = (
    "SELECT doc_id, nullif(trim(regexp_extract(a, '(?is)(?:^|\\n)#+ Risk[^\\n]*\\n(.*?)(?:\\n#+ |\\n?$)', 1)), '') AS risk, nullif(regexp_extract(a, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '') AS json_text "
    "FROM (SELECT doc_id, '## Summary' || chr(10) || text || chr(10) || '## Risk' || chr(10) || 'low' || chr(10) || '```json' || chr(10) || '{\"a\": 1}' || chr(10) || '```' || chr(10) AS a FROM documents WHERE text IS NOT NULL)"
)


def symbol_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the symbols that the parsers find, from the stored texts."""
    s = source_symbols(spark, folder).withColumn("file_id", F.concat_ws("/", "repository_id", "path"))
    s = s.select(F.concat_ws("#", "file_id", "name", F.col("start_line").cast("string")).alias("id"), "file_id", "start_line", "end_line")
    f = table(spark, folder, "file_info").select(F.concat_ws("/", "repository_id", "path").alias("file_id"), "content").distinct()
    return search.symbol_chunks(s, f)


QUERIES = {
    f.__name__: f
    for f in (source_symbols, source_imports, source_calls, source_call_edges, analysis_summary, routes, junit_parse, json_report_parse, gitlog_parse, ci_commands, section_parse, symbol_chunks)
}
