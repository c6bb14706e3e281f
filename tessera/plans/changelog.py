"""Queries over the changelog."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import changelog as C
from tessera.plans.registry import query
from tessera.sources.tables import CHANGELOG_SQL, changelog

MOMENT = datetime.datetime(1998, 1, 1)


@query(
    """SELECT * FROM changelog WHERE starts_with(file_path, 'src/c1') AND cluster = '1-URGENT' AND created_at >= TIMESTAMP '1996-01-01'
    AND created_at <= TIMESTAMP '1999-01-01' ORDER BY created_at DESC, id DESC LIMIT 200""",
    CHANGELOG_SQL,
)
def flt_01_changelog_filter(spark, sf_dir):
    return C.query(changelog(spark, sf_dir), prefix="src/c1", cluster="1-URGENT", since=F.expr("timestamp_ntz'1996-01-01'"), until=F.expr("timestamp_ntz'1999-01-01'"), limit=200)


@query("SELECT * FROM changelog WHERE breaking_changes ORDER BY created_at, id LIMIT 50 OFFSET 20", CHANGELOG_SQL)
def flt_02_changelog_page(spark, sf_dir):
    return C.query(changelog(spark, sf_dir), breaking=True, order="asc", limit=50, offset=20)


@query("SELECT * FROM changelog WHERE commit_sha IS NULL AND file_path IN (SELECT file_path FROM changelog WHERE verification_status = 'P')", CHANGELOG_SQL)
def flt_13_pending(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return C.pending(own, own.where("verification_status = 'P'"))


@query("SELECT count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM changelog WHERE cluster = '2-HIGH'", CHANGELOG_SQL)
def ag_01_changelog_span(spark, sf_dir):
    return C.span(changelog(spark, sf_dir), cluster="2-HIGH")


def _group(by):
    return f"SELECT coalesce({by}, '(none)') AS key, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM changelog GROUP BY {by} ORDER BY n DESC, {by} NULLS FIRST LIMIT 2000"


@query(_group("cluster"), CHANGELOG_SQL)
def ag_02_group_by_cluster(spark, sf_dir):
    return C.group(changelog(spark, sf_dir), "cluster")


@query(_group("author_name"), CHANGELOG_SQL)
def ag_02_group_by_author(spark, sf_dir):
    return C.group(changelog(spark, sf_dir), "author_name")


@query(_group("file_path"), CHANGELOG_SQL)
def ag_02_group_by_file(spark, sf_dir):
    return C.group(changelog(spark, sf_dir), "file_path")


@query("SELECT count(*) AS groups FROM (SELECT DISTINCT author_name FROM changelog)", CHANGELOG_SQL)
def ag_03_group_count(spark, sf_dir):
    return C.group_count(changelog(spark, sf_dir), "author_name")


def _timeline(form):
    return f"""SELECT strftime(created_at, '{form}') AS bucket, count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT coalesce(author_name, author_instance_id)) AS authors,
    count(*) FILTER (breaking_changes) AS breaking FROM changelog GROUP BY 1"""


@query(_timeline("%Y-%m-%d"), CHANGELOG_SQL)
def ag_04_timeline_day(spark, sf_dir):
    return C.timeline(changelog(spark, sf_dir), "day")


@query(_timeline("%Y-W%W"), CHANGELOG_SQL)
def ag_04_timeline_week(spark, sf_dir):
    return C.timeline(changelog(spark, sf_dir), "week")


@query(_timeline("%Y-%m"), CHANGELOG_SQL)
def ag_04_timeline_month(spark, sf_dir):
    return C.timeline(changelog(spark, sf_dir), "month")


@query("SELECT file_path, count(*) AS churn, count(*) FILTER (breaking_changes) AS breaking FROM changelog GROUP BY 1", CHANGELOG_SQL)
def ag_13_churn(spark, sf_dir):
    return C.churn(changelog(spark, sf_dir))


@query("SELECT file_path, count(*) AS churn, count(*) FILTER (breaking_changes) AS breaking FROM (SELECT * FROM changelog ORDER BY created_at DESC, id DESC LIMIT 2000) GROUP BY 1", CHANGELOG_SQL)
def ag_13_churn_capped(spark, sf_dir):
    return C.churn(changelog(spark, sf_dir), cap=2000)


@query("SELECT verification_status, count(*) AS n FROM changelog GROUP BY 1", CHANGELOG_SQL)
def ag_20_status_counts(spark, sf_dir):
    return C.status_counts(changelog(spark, sf_dir))


_LAST = "QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) "


@query("SELECT * FROM changelog WHERE created_at <= TIMESTAMP '1998-01-01' " + _LAST + "= 1", CHANGELOG_SQL)
def jn_09_as_of(spark, sf_dir):
    return C.as_of(changelog(spark, sf_dir), F.expr("timestamp_ntz'1998-01-01'"))


@query("SELECT id, file_path, created_at, lag(id) OVER w AS previous_id, lag(created_at) OVER w AS previous_at FROM changelog WINDOW w AS (PARTITION BY file_path ORDER BY created_at, id)", CHANGELOG_SQL)
def jn_09_previous(spark, sf_dir):
    return C.previous(changelog(spark, sf_dir))


@query(
    """SELECT e.id, e.file_path, (SELECT max_by(s.id, (s.created_at, s.id)) FROM changelog s WHERE s.id % 3 = 0 AND s.file_path = e.file_path AND s.created_at <= e.created_at) AS snapshot_id FROM changelog e""",
    CHANGELOG_SQL,
)
def jn_08_nearest_snapshot(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return C.nearest_snapshots(own, own.where("id % 3 = 0").select("file_path", "created_at", F.col("id").alias("snapshot_id")))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) AS INTEGER) AS place FROM changelog " + _LAST + "<= 3", CHANGELOG_SQL)
def wn_03_latest_per_file(spark, sf_dir):
    return C.latest(changelog(spark, sf_dir), 3)


@query("SELECT * EXCLUDE (verification_status), CASE WHEN file_path = 'src/c7/f7.ts' AND row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) <= 3 THEN 'verified' ELSE verification_status END AS verification_status FROM changelog", CHANGELOG_SQL)
def snk_08_verify_last(spark, sf_dir):
    return C.verify_last(changelog(spark, sf_dir), "src/c7/f7.ts", 3, "verified")


@query("SELECT * EXCLUDE (commit_sha), CASE WHEN id % 2 = 0 AND commit_sha IS NULL THEN 'new' ELSE commit_sha END AS commit_sha FROM changelog", CHANGELOG_SQL)
def snk_09_stamp_commit(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return C.stamp(own, own.where("id % 2 = 0"), "new")


@query("SELECT * EXCLUDE (author_name), CASE WHEN author_name IS NULL AND id % 4 = 0 THEN 'b' || (id % 9) ELSE author_name END AS author_name FROM changelog", CHANGELOG_SQL)
def snk_10_backfill_authors(spark, sf_dir):
    own = changelog(spark, sf_dir)
    return C.backfill_authors(own, own.where("id % 4 = 0").select("id", F.concat(F.lit("b"), F.col("id") % 9).alias("author_name")))


@query("SELECT id, file_path FROM changelog ORDER BY created_at, id LIMIT 25 OFFSET 100", CHANGELOG_SQL)
def tk_02_offset_page(spark, sf_dir):
    return C.query(changelog(spark, sf_dir), order="asc", limit=25, offset=100).select("id", "file_path")


@query("SELECT * FROM changelog WHERE id = 7", CHANGELOG_SQL)
def src_07_point_lookup(spark, sf_dir):
    return changelog(spark, sf_dir).where("id = 7")
