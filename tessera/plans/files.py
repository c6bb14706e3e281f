"""Queries over file records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import files as P
from tessera.operators import graph as G
from tessera.operators import changelog as C
from tessera.plans.registry import query
from tessera.sources.live import IGNORED_SEGMENTS, live_files
from tessera.sources.shared import shared_folder
from tessera.sources.tables import CHANGELOG_SQL, FILES_SQL, changelog, files, read


@query("SELECT id, file_path, purpose FROM files WHERE list_contains(patterns, 'p2')", FILES_SQL)
def flt_06_has_pattern(spark, sf_dir):
    return P.with_pattern(files(spark, sf_dir), "p2").select("id", "file_path", "purpose")


@query(
    r"""SELECT id, file_path, cluster, loc, CASE WHEN length(s) > 80 THEN substr(s, 1, 79) || '…' ELSE s END AS summary FROM (
      SELECT *, coalesce(CASE WHEN trim(purpose) <> '' THEN trim(purpose) END, CASE WHEN trim(blurb) <> '' THEN trim(blurb) END, 'no summary') AS s FROM files
      WHERE starts_with(file_path, 'src/src1') AND contains(lower(concat_ws(' ', file_path, cluster, blurb, purpose, array_to_string(tags, ' '), array_to_string(patterns, ' '))), 'en'))
    ORDER BY file_path, id LIMIT 40 OFFSET 5""",
    FILES_SQL,
)
def flt_07_catalog(spark, sf_dir):
    return P.catalog(files(spark, sf_dir), prefix="src/src1", search="en", offset=5, limit=40)


@query(
    r"""SELECT id, regexp_matches(p, '/(__tests__|__mocks__|test|tests|spec|fixtures)/') OR regexp_matches(p, '\.(test|spec)\.[cm]?[jt]sx?$') AS audit,
      regexp_matches(p, '/(__tests__|__mocks__|test|tests|spec|specs|fixtures)/') OR regexp_matches(p, '\.(test|spec)\.[cm]?[jt]sx?$') AS reachability,
      regexp_matches(p, '/(__tests__|test|tests|spec)/') OR regexp_matches(lower(p), '\.(test|spec)\.[cm]?[jt]sx?$') AS cycles
    FROM (SELECT id, CASE id % 4 WHEN 0 THEN file_path WHEN 1 THEN replace(file_path, '.ts', '.spec.mjs') WHEN 2 THEN 'a/specs/' || file_path ELSE 'a/__mocks__/' || file_path END AS p FROM files)""",
    FILES_SQL,
)
def flt_08_test_paths(spark, sf_dir):
    path, n = F.col("file_path"), F.col("id") % 4
    moved = F.when(n == 0, path).when(n == 1, F.replace(path, F.lit(".ts"), F.lit(".spec.mjs"))).when(n == 2, F.concat(F.lit("a/specs/"), path)).otherwise(F.concat(F.lit("a/__mocks__/"), path))
    return files(spark, sf_dir).select("id", *(P.is_test(moved, variant).alias(variant) for variant in P.TEST_PATHS))


@query("SELECT id FROM files WHERE file_path = 'src/src1' OR starts_with(file_path, 'src/src1/') OR starts_with(file_path, 'src/src2/')", FILES_SQL)
def flt_09_path_filters(spark, sf_dir):
    return files(spark, sf_dir).where(P.under_any(F.col("file_path"), ["src/src1", "src/src2/"])).select("id")


_HASHED = "SELECT *, sha1(CASE WHEN id % 7 = 0 THEN 'old' ELSE content END) AS file_hash FROM files"


@query(f"SELECT f.file_path, CASE WHEN f.id % 10 = 0 THEN 'pruned' WHEN f.file_hash <> sha1(content) THEN 'stale' WHEN trim(purpose) = '' THEN 'incomplete' ELSE 'complete' END AS state FROM ({_HASHED}) f", FILES_SQL)
def flt_15_staleness(spark, sf_dir):
    own = files(spark, sf_dir).withColumn("file_hash", F.sha1(F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content"))))
    return P.staleness(own, own.where("id % 10 <> 0").select("file_path", F.sha1("content").alias("hash")))


@query("SELECT pattern, count(DISTINCT file_path) AS files FROM (SELECT file_path, unnest(patterns) AS pattern FROM files) WHERE trim(pattern) <> '' GROUP BY 1", FILES_SQL)
def ag_05_pattern_counts(spark, sf_dir):
    return P.pattern_counts(files(spark, sf_dir))


_LINKS = "links AS (SELECT DISTINCT id AS src, (id * 7 + 3) % 50 AS dst FROM files UNION SELECT DISTINCT id % 20, id FROM files)"
_DEGREES = """deg AS (SELECT file_path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i + o) AS BIGINT) AS coupling FROM (
    SELECT a.file_path, 0 AS i, 1 AS o FROM links JOIN files a ON a.id = src UNION ALL SELECT b.file_path, 1, 0 FROM links JOIN files b ON b.id = dst) GROUP BY 1),
  churned AS (SELECT f.file_path, count(*) AS churn, count(*) FILTER (breaking_changes) AS breaking FROM changelog c JOIN files f ON f.id = CAST(regexp_extract(c.file_path, '/f([0-9]+)', 1) AS BIGINT) GROUP BY 1)"""
_CYCLES = """reach AS (WITH RECURSIVE r(a, b) AS (SELECT src, dst FROM links UNION SELECT r.a, l.dst FROM r JOIN links l ON l.src = r.b) SELECT a, b FROM r),
  cycles AS (SELECT p.a AS id, count(DISTINCT p.b) AS cycle_size FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a GROUP BY 1)"""


def _links(own):
    return own.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 50).alias("dst")).union(own.select(F.col("id") % 20, "id")).distinct()


def _degrees(own):
    d = G.degrees(_links(own))
    return own.select("id", "file_path").join(d.withColumnRenamed("node", "id"), "id").select("file_path", "fan_in", "fan_out", "coupling")


def _churned(spark, sf_dir, own):
    """Changes and breaking changes of each file in the changelog."""
    entries = changelog(spark, sf_dir).select(F.regexp_extract("file_path", "/f([0-9]+)", 1).cast("long").alias("id"), "breaking_changes")
    return entries.join(own.select("id", "file_path"), "id").groupBy("file_path").agg(F.count("*").alias("churn"), F.count_if("breaking_changes").alias("breaking"))


@query(
    """SELECT file_path, severity FROM (SELECT f.file_path, least(10, (CASE WHEN loc > 500 THEN 2 ELSE 0 END) + (CASE WHEN loc > 1000 THEN 2 ELSE 0 END) + (CASE WHEN coupling > 20 THEN 3 ELSE 0 END)
      + (CASE WHEN coupling > 40 THEN 1 ELSE 0 END) + (CASE WHEN cycle_size > 1 THEN 3 ELSE 0 END) + (CASE WHEN cycle_size > 4 THEN 1 ELSE 0 END) + (CASE WHEN churn > 5 THEN 2 ELSE 0 END) + (CASE WHEN churn > 10 THEN 1 ELSE 0 END)
      + (CASE WHEN len(hazards) > 3 THEN 2 ELSE 0 END) + (CASE WHEN len(hazards) > 6 THEN 1 ELSE 0 END)) AS severity
      FROM files f LEFT JOIN deg USING (file_path) LEFT JOIN churned USING (file_path) LEFT JOIN cycles USING (id)) WHERE severity >= 3""",
    FILES_SQL, CHANGELOG_SQL, _LINKS, _DEGREES, _CYCLES,
)
def ag_15_smells(spark, sf_dir):
    own = files(spark, sf_dir)
    parts = G.strong_components(_links(own))
    sizes = parts.join(parts.groupBy("component").agg(F.count("*").alias("cycle_size")), "component").select(F.col("node").alias("id"), "cycle_size")
    cycles = sizes.join(own.select("id", "file_path"), "id").select("file_path", "cycle_size")
    return P.smells(own, _degrees(own).select("file_path", "coupling"), _churned(spark, sf_dir, own).select("file_path", "churn"), cycles)


_PARTS = {
    "hazards": "0.28 * least(len(hazards) / 5.0, 1)", "fan_in": "0.20 * least(fan_in / greatest(max(fan_in) OVER (), 1), 1)", "fan_out": "0.12 * least(fan_out / greatest(max(fan_out) OVER (), 1), 1)",
    "churn": "0.18 * least(churn / greatest(max(churn) OVER (), 1), 1)", "breaking": "0.10 * least(breaking / 3.0, 1)", "loc": "0.07 * least(loc / 800.0, 1)", "stale": "0.05 * least((id % 45) / 30.0, 1)",
}


@query(
    f"""SELECT file_path, round({" + ".join(f"p_{n}" for n in _PARTS)}, 9) AS risk,
      array_to_string(list_transform(list_filter(list_sort([{", ".join(f"{{'o': -round(p_{n}, 9), 'name': '{n}'}}" for n in _PARTS)}]), lambda r: r.o < 0)[1:3], lambda r: r.name), ',') AS reasons
      FROM (SELECT file_path, {", ".join(f"CAST({v} AS DOUBLE) AS p_{n}" for n, v in _PARTS.items())} FROM (
        SELECT f.id, file_path, loc, hazards, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(churn, 0) AS churn, coalesce(breaking, 0) AS breaking FROM files f LEFT JOIN deg USING (file_path) LEFT JOIN churned USING (file_path)))
      ORDER BY risk DESC, file_path LIMIT 20""",
    FILES_SQL, CHANGELOG_SQL, _LINKS, _DEGREES,
)
def ag_16_hotspots(spark, sf_dir):
    own = files(spark, sf_dir).withColumn("stale_days", F.col("id") % 45)
    return P.hotspots(own, _degrees(own).select("file_path", "fan_in", "fan_out"), _churned(spark, sf_dir, own))


_FILLED = """filled AS (SELECT id, loc, list_filter([CASE WHEN trim(purpose) <> '' THEN 'purpose' END, CASE WHEN trim(blurb) <> '' THEN 'blurb' END, CASE WHEN len(tags) > 0 THEN 'tags' END,
    CASE WHEN len(patterns) > 0 THEN 'patterns' END, CASE WHEN len(hazards) > 0 THEN 'hazards' END], lambda x: x IS NOT NULL) AS have FROM files),
  tiers AS (SELECT *, CASE WHEN loc <= 0 THEN 'small' WHEN loc <= 50 THEN 'tiny' WHEN loc <= 200 THEN 'small' WHEN loc <= 600 THEN 'medium' WHEN loc <= 1500 THEN 'large' ELSE 'huge' END AS tier FROM filled)"""


@query(
    """SELECT id, tier, round(len(list_intersect(need, have)) / len(need), 6) AS required_fill, round(len(have) / 9, 6) AS overall_fill FROM (SELECT *,
      CASE tier WHEN 'tiny' THEN ['purpose', 'blurb'] WHEN 'small' THEN ['purpose', 'blurb', 'tags'] WHEN 'medium' THEN ['purpose', 'blurb', 'tags', 'patterns']
      WHEN 'large' THEN ['purpose', 'blurb', 'tags', 'patterns', 'hazards'] ELSE ['purpose', 'blurb', 'tags', 'patterns', 'hazards', 'source_highlights'] END AS need FROM tiers)""",
    FILES_SQL, _FILLED,
)
def ag_17_completeness(spark, sf_dir):
    return P.completeness(P.filled_fields(files(spark, sf_dir)))


@query("SELECT coalesce(cluster, 'uncategorized') AS cluster, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM files GROUP BY 1", FILES_SQL)
def ag_18_clusters(spark, sf_dir):
    return P.clusters(files(spark, sf_dir))


@query("SELECT id, array_to_string(list_filter(['purpose', 'blurb', 'tags', 'patterns', 'hazards'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM filled WHERE len(have) < 5", FILES_SQL, _FILLED.split(",\n  tiers")[0])
def ag_28_missing_fields(spark, sf_dir):
    return P.missing_fields(files(spark, sf_dir))


@query("SELECT workspace, count(*) AS files FROM files GROUP BY 1", FILES_SQL)
def ag_31_workspace_files(spark, sf_dir):
    return files(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("files"))


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.id IS NULL THEN 'untracked' WHEN b.id IS NULL THEN 'deleted' WHEN a.id % 5 = 0 THEN 'modified' ELSE 'clean' END AS state FROM (SELECT * FROM files WHERE id % 3 <> 0) a FULL JOIN (SELECT * FROM files WHERE id % 4 <> 0) b ON a.file_path = b.file_path) GROUP BY 1", FILES_SQL)
def ag_23_worktree_counts(spark, sf_dir):
    return df_05_worktree_status(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.id IS NULL THEN 'untracked' WHEN b.id IS NULL THEN 'deleted' WHEN a.id % 5 = 0 THEN 'modified' ELSE 'clean' END AS state FROM (SELECT * FROM files WHERE id % 3 <> 0) a FULL JOIN (SELECT * FROM files WHERE id % 4 <> 0) b ON a.file_path = b.file_path", FILES_SQL)
def df_05_worktree_status(spark, sf_dir):
    own = files(spark, sf_dir)
    was = own.where("id % 3 <> 0").select("file_path", F.sha2("content", 256).alias("hash"))
    now = own.where("id % 4 <> 0").select("file_path", F.sha2(F.when(F.col("id") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("hash"))
    return P.worktree(was, now)


@query("SELECT id, file_path, CASE WHEN id % 3 = 1 THEN 'new' ELSE purpose END AS purpose, CASE WHEN id % 3 = 1 THEN 0 ELSE loc END AS loc FROM files WHERE id % 3 <> 2 UNION ALL SELECT id, file_path, 'new', 0 FROM files WHERE id % 3 = 2", FILES_SQL)
def snk_01_upsert(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path", "purpose", "loc")
    new = own.where("id % 3 <> 0").withColumn("purpose", F.lit("new")).withColumn("loc", F.lit(0))
    return P.upsert(own.where("id % 3 <> 2"), new, ["id", "file_path"])


@query("SELECT id, file_path, purpose, CASE WHEN id % 3 = 1 THEN 0 ELSE loc END AS loc FROM files", FILES_SQL)
def snk_02_partial_upsert(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path", "purpose", "loc")
    return P.upsert(own, own.where("id % 3 = 1").withColumn("purpose", F.lit("x")).withColumn("loc", F.lit(0)), ["id", "file_path"], ["loc"])


@query("SELECT id, file_path FROM files WHERE NOT (cluster IS NOT NULL AND cluster = 'src3')", FILES_SQL)
def snk_16_delete_files(spark, sf_dir):
    own = files(spark, sf_dir)
    return P.without_files(own, own.where("cluster = 'src3'")).select("id", "file_path")


@query("SELECT id, file_path FROM files WHERE id % 2 = 0 UNION ALL SELECT id, file_path FROM files WHERE id % 2 = 1 AND id % 3 = 0", FILES_SQL)
def set_04_merge_missing(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path")
    return P.merge_missing(own.where("id % 2 = 0"), own.where("id % 3 = 0"), ["file_path"])


@query("SELECT id, CASE WHEN trim(purpose) = '' THEN 'from ' || id ELSE purpose END AS purpose, CASE WHEN len(patterns) = 0 AND id % 3 = 0 THEN 'z' ELSE array_to_string(patterns, ',') END AS patterns FROM files", FILES_SQL)
def set_05_fill_empty(spark, sf_dir):
    own = files(spark, sf_dir)
    new = own.select("id", F.concat(F.lit("from "), "id").alias("purpose"), F.when(F.col("id") % 3 == 0, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("patterns"))
    out = P.fill_empty(own.select("id", "purpose", "patterns"), new, "id", ["purpose", "patterns"])
    return out.withColumn("patterns", F.array_join("patterns", ","))


@query("SELECT id, file_path, created_at FROM changelog WHERE id % 2 = 0 UNION ALL SELECT id, file_path, created_at FROM changelog s WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM changelog t WHERE t.id % 2 = 0 AND t.file_path = s.file_path AND t.summary = s.summary AND t.created_at = s.created_at)", CHANGELOG_SQL)
def set_06_merge_changelog(spark, sf_dir):
    own = changelog(spark, sf_dir).select("id", "file_path", "summary", "created_at")
    return P.merge_missing(own.where("id % 2 = 0"), own.where("id % 3 = 0"), ["file_path", "summary", "created_at"]).drop("summary")


@query("SELECT id, file_path FROM files WHERE id % 5 = 0", FILES_SQL)
def set_07_untracked(spark, sf_dir):
    own = files(spark, sf_dir).select("id", "file_path")
    return P.without_files(own, own.where("id % 5 <> 0"))


@query("SELECT id, file_path, verification_status AS hash, created_at FROM changelog QUALIFY lag(verification_status) OVER (PARTITION BY file_path ORDER BY created_at, id) IS DISTINCT FROM verification_status", CHANGELOG_SQL)
def snk_14_changed_snapshots(spark, sf_dir):
    return P.changed_snapshots(changelog(spark, sf_dir).select("id", "file_path", F.col("verification_status").alias("hash"), "created_at"))


@query("SELECT id, file_path FROM changelog QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC, id DESC) <= 10", CHANGELOG_SQL)
def snk_15_prune_snapshots(spark, sf_dir):
    return P.prune(changelog(spark, sf_dir).select("id", "file_path", "created_at")).select("id", "file_path")


@query("SELECT file_path, CASE WHEN id % 4 = 0 THEN 'done' ELSE 'pending' END AS status FROM files WHERE id % 2 = 0 UNION ALL SELECT file_path, 'pending' FROM files WHERE id % 3 = 0 AND NOT (id % 2 = 0 AND id % 4 <> 0)", FILES_SQL)
def snk_19_enqueue(spark, sf_dir):
    own = files(spark, sf_dir)
    queue = own.where("id % 2 = 0").select("file_path", F.when(F.col("id") % 4 == 0, "done").otherwise("pending").alias("status"))
    new = own.where("id % 3 = 0").select("file_path", F.lit("pending").alias("status"))
    return P.enqueue(queue, new.union(new))


@query("SELECT id, array_to_string(list_concat(hazards, CASE WHEN list_contains(hazards, lang) THEN [] ELSE [lang] END), ',') AS hazards, array_to_string(list_concat([lang], list_filter(hazards, lambda h, i: list_position(hazards, h) = i)), ',') AS ranged, 1 AS added_plain, CAST(len(list_distinct(hazards)) AS INTEGER) AS added_ranged FROM (SELECT id, hazards, language AS lang FROM files)", FILES_SQL)
def snk_27_hazard_sync(spark, sf_dir):
    return P.hazard_sync(files(spark, sf_dir).withColumn("ranged", F.array("language")), "hazards", "ranged")


@query(r"SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=" + '"(/[^"]+)"' + r"', 1)) AS href FROM pages)")
def ca_01_links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), 1))).alias("href"))


@query(
    """SELECT u.w AS symbol, s.id AS file_path, u.id AS used_in, u.n AS matches FROM (SELECT w, min(id) AS id FROM said WHERE length(w) >= 12 GROUP BY 1) s JOIN said u ON u.w = s.w AND u.id <> s.id""",
    FILES_SQL, "said AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS w FROM files) GROUP BY ALL)",
)
def ca_06_symbol_usages(spark, sf_dir):
    """Names of twelve characters and more belong to the first file that says them; where all others use them."""
    own = files(spark, sf_dir).select(F.col("id").alias("file_path"), "content")
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][\w$]*)"), 1))
    symbols = own.select("file_path", F.explode(F.filter(words, lambda w: F.length(w) >= 12)).alias("name")).groupBy("name").agg(F.min("file_path").alias("file_path"))
    return P.symbol_usages(own, symbols)


@query()
def ca_13_source_chunks(spark, sf_dir):
    return P.chunk_lines(files(spark, sf_dir))


@query()
def df_01_unified_diff(spark, sf_dir):
    own = files(spark, sf_dir)
    return P.unified_diffs(own.select("id", F.col("content").alias("old"), F.regexp_replace("content", "the", "THE").alias("new")))


@query(
    r"""SELECT id, CAST(sum(greatest(n, 0)) AS BIGINT) AS added, CAST(sum(greatest(-n, 0)) AS BIGINT) AS removed FROM (SELECT id, line, sum(s) AS n FROM (
      SELECT id, unnest(string_split(content, chr(10))) AS line, -1 AS s FROM files UNION ALL SELECT id, unnest(string_split(replace(content, 'the', 'THE'), chr(10))), 1 FROM files) GROUP BY 1, 2) GROUP BY 1""",
    FILES_SQL,
)
def df_02_diff_stats(spark, sf_dir):
    return P.diff_stats(files(spark, sf_dir).select("id", F.col("content").alias("old"), F.regexp_replace("content", "the", "THE").alias("new")))


@query(
    """SELECT file_path, 'h' AS label, 1 + id % 3 AS start_line, 3 + id % 3 AS end_line, CAST(least(3 + id % 3, n) - id % 3 AS BIGINT) AS lines
    FROM (SELECT id, file_path, len(string_split(content, chr(10))) AS n FROM files) WHERE n > id % 3""",
    FILES_SQL,
)
def df_03_highlight_overlap(spark, sf_dir):
    own = files(spark, sf_dir)
    highlights = own.select("file_path", F.lit("h").alias("label"), (1 + F.col("id") % 3).alias("start_line"), (3 + F.col("id") % 3).alias("end_line"))
    return P.highlight_overlap(highlights, own.select("file_path", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")))).alias("line")))


@query("SELECT 'source=' || coalesce(source, 'none') || '/lang=' || coalesce(lang, 'none') AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents WHERE source IS DISTINCT FROM 'src2' GROUP BY ALL")
def src_09_live_tree(spark, sf_dir):
    """Texts written as a tree of folders, which is then listed; one folder is ignored, and so is what Spark writes beside the texts."""
    folder = f"{shared_folder(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    texts = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("value"))
    texts.write.partitionBy("source", "lang").text(folder)
    found = live_files(spark, folder, segments=(*IGNORED_SEGMENTS, "source=src2")).where("file_path like '%.txt'")
    return found.groupBy(F.regexp_extract("file_path", "^(.*)/", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"))
