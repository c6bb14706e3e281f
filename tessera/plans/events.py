"""Queries over identity-to-file events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.plans.registry import query
from tessera.sources.tables import EDGES_SQL, KINDS, edges

A, B = "u1", "u2"
FILE = "src/d7/f17.ts"


@query(
    """SELECT s.* FROM edges s WHERE kind = 'surfaced' AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.kind = 'resolved'
    AND r.identity_name = s.identity_name AND r.workspace = s.workspace AND r.file_path = s.file_path AND r.detail = s.detail AND r.ts > s.ts)""",
    EDGES_SQL,
)
def jn_03_open_hazards(spark, sf_dir):
    return E.open_hazards(edges(spark, sf_dir))


@query(
    """SELECT s.id, s.identity_name, s.workspace, s.file_path, s.detail, s.ts, min(r.ts) AS resolved_at, min(r.ts) - s.ts AS took_ms
    FROM edges s JOIN edges r ON r.kind = 'resolved' AND r.identity_name = s.identity_name AND r.workspace = s.workspace
    AND r.file_path = s.file_path AND r.detail = s.detail AND r.ts > s.ts WHERE s.kind = 'surfaced'
    GROUP BY s.id, s.identity_name, s.workspace, s.file_path, s.detail, s.ts""",
    EDGES_SQL,
)
def jn_04_next_resolution(spark, sf_dir):
    return E.resolve_times(edges(spark, sf_dir))


@query("SELECT * FROM edges WHERE identity_name = 'u1' AND kind = 'surfaced' AND ts >= 0 ORDER BY ts DESC, id DESC LIMIT 100", EDGES_SQL)
def flt_04_event_filter(spark, sf_dir):
    return E.filter_events(edges(spark, sf_dir), identity=A, kind="surfaced", since=0)


@query("SELECT * FROM edges WHERE kind IN ('surfaced', 'resolved') AND detail = 'h17' ORDER BY ts, id LIMIT 100", EDGES_SQL)
def flt_12_when_did(spark, sf_dir):
    return E.when_did(edges(spark, sf_dir), "hazard", "h17")


@query("SELECT * FROM edges WHERE kind = 'commit' AND (contains(detail, '1') OR detail IS NULL) ORDER BY ts, id LIMIT 100", EDGES_SQL)
def flt_12_when_did_commit(spark, sf_dir):
    return E.when_did(edges(spark, sf_dir), "commit", "1")


@query("SELECT identity_name, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + " FROM edges GROUP BY identity_name", EDGES_SQL)
def ag_06_count_by_kind(spark, sf_dir):
    return E.count_by_kind(edges(spark, sf_dir))


_TOP = """SELECT identity_name, file_path, edge_count, last_ts, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY identity_name
    ORDER BY edge_count DESC, last_ts DESC, file_path) AS INTEGER) AS rank FROM (SELECT identity_name, file_path, count(*) AS edge_count, max(ts) AS last_ts
    FROM edges WHERE kind <> 'lookup' GROUP BY ALL))"""


@query(_TOP + " WHERE rank <= 5", EDGES_SQL)
def ag_07_top_files(spark, sf_dir):
    return E.top_files(edges(spark, sf_dir), limit=5)


@query(
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY identity_name ORDER BY last_ts DESC, file_path) AS INTEGER) AS rank
    FROM (SELECT identity_name, file_path, count(*) AS touches, max(ts) AS last_ts FROM edges GROUP BY ALL)) WHERE rank <= 5""",
    EDGES_SQL,
)
def ag_08_recent_files(spark, sf_dir):
    return E.recent_files(edges(spark, sf_dir), limit=5)


@query(
    f"""SELECT identity_name, count(*) AS edge_count, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (kind = 'commit') AS commits,
    string_agg(kind, ',' ORDER BY ts, kind) AS kinds FROM edges WHERE file_path = '{FILE}' GROUP BY identity_name""",
    EDGES_SQL,
)
def ag_09_lineage(spark, sf_dir):
    return E.lineage(edges(spark, sf_dir), FILE)


@query(
    """SELECT c.*, m.mean_resolve_ms FROM (SELECT identity_name, count(*) FILTER (kind = 'surfaced') AS hazards_surfaced,
    count(*) FILTER (kind = 'resolved') AS hazards_resolved, count(DISTINCT file_path) AS files FROM edges GROUP BY 1) c
    LEFT JOIN (SELECT identity_name, CAST(floor(avg(took) + 0.5) AS BIGINT) AS mean_resolve_ms FROM (
      SELECT s.identity_name, s.id, min(r.ts) - s.ts AS took FROM edges s JOIN edges r ON r.kind = 'resolved' AND r.identity_name = s.identity_name
      AND r.workspace = s.workspace AND r.file_path = s.file_path AND r.detail = s.detail AND r.ts > s.ts WHERE s.kind = 'surfaced'
      GROUP BY s.identity_name, s.id, s.ts) GROUP BY 1) m ON m.identity_name = c.identity_name""",
    EDGES_SQL,
)
def ag_10_specialty_signature(spark, sf_dir):
    return E.signature(edges(spark, sf_dir))


@query(
    f"""SELECT identity_name, directory, edge_count, files, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY identity_name ORDER BY edge_count DESC, directory) AS INTEGER) AS rank
    FROM (SELECT identity_name, regexp_replace(file_path, '/[^/]*$', '') AS directory, CAST(sum(edge_count) AS BIGINT) AS edge_count, count(*) AS files
    FROM ({_TOP} WHERE rank <= 50) GROUP BY ALL)) WHERE rank <= 15""",
    EDGES_SQL,
)
def ag_10_directories(spark, sf_dir):
    return E.directory_rollup(edges(spark, sf_dir))


@query(
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY identity_name ORDER BY n DESC, detail) AS INTEGER) AS rank
    FROM (SELECT identity_name, detail, count(*) AS n FROM edges WHERE kind IN ('pattern_added', 'pattern_removed') AND detail IS NOT NULL GROUP BY ALL)) WHERE rank <= 20""",
    EDGES_SQL,
)
def ag_10_patterns(spark, sf_dir):
    return E.pattern_rollup(edges(spark, sf_dir))


@query(
    """SELECT identity_name, round(0.4 * CASE WHEN fm > fl THEN (f - fl) / (fm - fl) ELSE 0 END + 0.35 * CASE WHEN pm > pl THEN (p - pl) / (pm - pl) ELSE 0 END
      + 0.25 * CASE WHEN hm > hl THEN (h - hl) / (hm - hl) ELSE 0 END, 6) AS score
    FROM (SELECT *, min(f) OVER () AS fl, max(f) OVER () AS fm, min(p) OVER () AS pl, max(p) OVER () AS pm, min(h) OVER () AS hl, max(h) OVER () AS hm FROM (
      SELECT identity_name, CAST(count(*) FILTER (starts_with(file_path, 'src/d7') AND kind <> 'lookup') AS DOUBLE) AS f,
      CAST(count(*) FILTER (kind IN ('pattern_added', 'pattern_removed') AND detail = 'h17') AS DOUBLE) AS p,
      CAST(count(*) FILTER (kind = 'resolved' AND detail = 'h27') AS DOUBLE) AS h FROM edges GROUP BY 1))
    WHERE score > 0 ORDER BY score DESC, identity_name LIMIT 10""",
    EDGES_SQL,
)
def ag_11_recommend(spark, sf_dir):
    return E.recommend(edges(spark, sf_dir), directory="src/d7", pattern="h17", hazard="h27")


@query(
    """SELECT detail, workspace, a_surfaced, b_surfaced, CASE WHEN a_surfaced > 0 THEN ra ELSE 0 END AS a_resolved, CASE WHEN b_surfaced > 0 THEN rb ELSE 0 END AS b_resolved
    FROM (SELECT detail, workspace, count(*) FILTER (identity_name = 'u1' AND kind = 'surfaced') AS a_surfaced, count(*) FILTER (identity_name = 'u5' AND kind = 'surfaced') AS b_surfaced,
      count(*) FILTER (identity_name = 'u1' AND kind = 'resolved') AS ra, count(*) FILTER (identity_name = 'u5' AND kind = 'resolved') AS rb
      FROM edges WHERE detail IS NOT NULL GROUP BY 1, 2) WHERE a_surfaced > 0 OR b_surfaced > 0""",
    EDGES_SQL,
)
def jn_05_hazard_diff(spark, sf_dir):
    return E.hazard_diff(edges(spark, sf_dir), "u1", "u5")


@query(
    """SELECT coalesce(a.file_path, b.file_path) AS file_path, a.n AS a_count, b.n AS b_count, CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' ELSE 'shared' END AS bucket
    FROM (SELECT file_path, count(*) AS n FROM edges WHERE identity_name = 'u1' AND kind <> 'lookup' GROUP BY 1) a
    FULL JOIN (SELECT file_path, count(*) AS n FROM edges WHERE identity_name = 'u2' AND kind <> 'lookup' GROUP BY 1) b ON a.file_path = b.file_path""",
    EDGES_SQL,
)
def jn_06_shared_files(spark, sf_dir):
    return E.file_diff(edges(spark, sf_dir), A, B)


@query(
    """SELECT detail, CASE WHEN a + b = 2 THEN 'shared' WHEN a = 1 THEN 'only_a' ELSE 'only_b' END AS bucket FROM (
    SELECT detail, max(CASE WHEN identity_name = 'u1' THEN 1 ELSE 0 END) AS a, max(CASE WHEN identity_name = 'u2' THEN 1 ELSE 0 END) AS b
    FROM edges WHERE identity_name IN ('u1', 'u2') AND kind IN ('pattern_added', 'pattern_removed') AND detail IS NOT NULL GROUP BY 1)""",
    EDGES_SQL,
)
def set_01_pattern_overlap(spark, sf_dir):
    return E.pattern_overlap(edges(spark, sf_dir), A, B)


@query(
    """SELECT id, identity_name, file_path, ts, unnest(CASE WHEN id % 3 = 0 THEN ['commit', 'surfaced', 'surfaced'] ELSE ['commit', 'pattern_added'] END) AS kind,
    unnest(CASE WHEN id % 3 = 0 THEN [NULL, 'x' || (id % 7), 'y'] ELSE [NULL, 'p' || (id % 5)] END) AS detail FROM edges WHERE kind = 'commit'""",
    EDGES_SQL,
)
def snk_12_commit_fan_out(spark, sf_dir):
    none = F.array().cast("array<string>")
    commits = edges(spark, sf_dir).where("kind = 'commit'").withColumns(
        {
            "hazards_added": F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("x"), F.col("id") % 7), F.lit("y"))).otherwise(none),
            "patterns_added": F.when(F.col("id") % 3 == 0, none).otherwise(F.array(F.concat(F.lit("p"), F.col("id") % 5))),
        }
    )
    return E.commit_fan_out(commits)


@query("SELECT id, identity_name, ts, ts - lag(ts) OVER (PARTITION BY identity_name ORDER BY ts, id) AS gap_ms FROM edges", EDGES_SQL)
def wn_10_previous_gap(spark, sf_dir):
    return E.session_gaps(edges(spark, sf_dir))


@query("SELECT DISTINCT identity_name FROM edges WHERE ts > (SELECT max(ts) - 86400000 FROM edges)", EDGES_SQL)
def st_06_dirty_identities(spark, sf_dir):
    own = edges(spark, sf_dir)
    return E.touched_identities(own, (own.agg(F.max("ts")).first()[0] or 0) - 86_400_000)


@query(
    """SELECT id, file_path, detail, ts, CAST(floor((2000000000000 - ts) / 86400000) AS BIGINT) AS age_days FROM edges s WHERE kind = 'surfaced' AND identity_name = 'u1' AND NOT EXISTS (
    SELECT 1 FROM edges r WHERE r.kind = 'resolved' AND r.identity_name = s.identity_name AND r.workspace = s.workspace AND r.file_path = s.file_path AND r.detail = s.detail AND r.ts > s.ts)""",
    EDGES_SQL,
)
def tr_10_resume_hazards(spark, sf_dir):
    return E.resume(edges(spark, sf_dir), A, 2_000_000_000_000)


@query("SELECT identity_name, string_agg(DISTINCT detail, ',' ORDER BY detail) AS details FROM edges WHERE kind = 'surfaced' GROUP BY 1", EDGES_SQL)
def ag_27_distinct_details(spark, sf_dir):
    own = edges(spark, sf_dir).where("kind = 'surfaced'")
    return own.groupBy("identity_name").agg(F.array_join(F.array_sort(F.collect_set("detail")), ",").alias("details"))
