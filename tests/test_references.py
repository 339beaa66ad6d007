from datetime import datetime as D

from codelode.operators import references as R

A, B, C, DEAD = "a" * 40, "b" * 40, "c0ffee1" + "0" * 33, "d" * 40
COMMITS = "repository_id string, commit_hash string, committed_at timestamp_ntz, created_at timestamp_ntz, parent_hashes string, live string, hash string, parent_hash string"
GONE = "repository_id string, commit_hash string, deleted_at timestamp_ntz, live string"


def commit(repo, h, parents, day=1, arrived=None):
    return (repo, h, D(2024, 1, day), D(2024, 2, arrived or day), parents, "x", "y", "z")


def test_orphans(spark, rows):
    commits = spark.createDataFrame([
        commit("r", " " + A.upper(), None), commit("r", A, None),  # the same commit twice
        commit("r", B, f"{A.upper()}; C0FFEE1 {DEAD},"), commit("r", C, "0" * 40), commit("r", DEAD, "abcdef0"),
        commit("s", B, A), commit(None, A, "1234567"), commit("s", None, "1234567"), commit("s", C, "123456"), commit("s", A + " ", "  "),
    ], COMMITS)
    gone = spark.createDataFrame([("r", DEAD.upper(), D(2024, 2, 1), "q"), ("r", A, D(2024, 1, 1), "q"), (None, B, D(2025, 1, 1), "q")], GONE)
    # DEAD is deleted, so it names nothing itself; A came after its removal and lives
    assert rows(R.orphan_references(commits, gone)) == [("r", B, DEAD)]
    report = R.orphan_report(commits, gone).where("repository_id = 'r'").first()
    assert (report.month, report.n_references, report.n_missing, report.n_deleted, report.n_late) == ("2024-01", 3, 0, 1, 0)


def test_late_parent_is_no_orphan(spark, rows):
    commits = spark.createDataFrame([commit("r", A, B, arrived=1), commit("r", B, None, arrived=9)], COMMITS)
    gone = spark.createDataFrame([], GONE)
    assert rows(R.orphan_references(commits, gone)) == []
    assert R.orphan_report(commits, gone).first().n_late == 1


def test_empty(spark, rows):
    empty = spark.createDataFrame([], COMMITS)
    assert rows(R.orphan_references(empty, spark.createDataFrame([], GONE))) == []
    assert rows(R.orphan_report(empty, spark.createDataFrame([], GONE))) == []


def test_hot_parent_and_hot_repository(spark, rows):
    commits = spark.createDataFrame([commit("r", f"{i:040x}", "f" * 40) for i in range(1, 600)], COMMITS)
    assert len(rows(R.orphan_references(commits, spark.createDataFrame([], GONE)))) == 599
