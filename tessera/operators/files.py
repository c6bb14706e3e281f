"""File records: catalogue, scoring, staleness, table merges and diffs, source text analysis."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import clamp_text
from tessera.sources.shared import cut, slices

#: Names that are broadcast at most, each at most a word long.
BROADCAST_NAMES = 100_000

REQUIRED = {
    "tiny": ("purpose", "blurb"),
    "small": ("purpose", "blurb", "tags"),
    "medium": ("purpose", "blurb", "tags", "patterns"),
    "large": ("purpose", "blurb", "tags", "patterns", "hazards"),
    "huge": ("purpose", "blurb", "tags", "patterns", "hazards", "source_highlights"),
}
FIELDS = ("purpose", "blurb", "tags", "patterns", "hazards", "conventions", "key_types", "data_flows", "source_highlights")
#: Paths of tests and fixtures; reachability leaves out configuration files too.
_TEST_DIRS, _TEST_NAMES = r"/(__tests__|__mocks__|test|tests|spec|fixtures)/", r"\.(test|spec)\.[cm]?[jt]sx?$"
_CONFIGURES = r"(^|/)(next|vite|vitest|jest|playwright|cypress|eslint|tailwind|postcss|babel|webpack)\.config\.[cm]?[jt]s$"
TEST_PATHS = {
    "audit": f"{_TEST_DIRS}|{_TEST_NAMES}",
    "reachability": f"/(__tests__|__mocks__|test|tests|spec|specs|fixtures)/|{_TEST_NAMES}|{_CONFIGURES}",
    "cycles": f"/(__tests__|test|tests|spec)/|(?i:{_TEST_NAMES})",
}


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def is_test(path: Column, variant: str = "audit") -> Column:
    return path.rlike(TEST_PATHS[variant])


def under_any(path: Column, filters: Sequence[str]) -> Column:
    """The path is one of the filters or below one; an empty filter takes all."""
    out = F.lit(False)
    for f in filters:
        out = out | (F.lit(True) if f == "" else (path == f) | path.startswith(f.rstrip("/") + "/"))
    return out


def catalog(files: DataFrame, *, prefix: str = "", cluster: str | None = None, search: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of files by path, with a summary: the first of purpose, blurb and a fixed text that is not blank."""
    text = F.lower(F.concat_ws(" ", "file_path", "cluster", "blurb", "purpose", F.array_join("tags", " "), F.array_join("patterns", " ")))
    out = files.where(F.col("file_path").startswith(prefix) & F.contains(text, F.lit(search.lower())))
    if cluster is not None:
        out = out.where(F.col("cluster") == cluster)
    filled = lambda c: F.when(~blank(F.col(c)), F.trim(c))
    summary = clamp_text(F.coalesce(filled("purpose"), filled("blurb"), F.lit("no summary")), 80)
    return out.select("id", "file_path", "cluster", "loc", summary.alias("summary")).orderBy("file_path", "id").offset(offset).limit(limit)


def pattern_counts(files: DataFrame) -> DataFrame:
    """Distinct files of each pattern that is not blank."""
    return files.select("file_path", F.explode("patterns").alias("pattern")).where(F.trim("pattern") != "").groupBy("pattern").agg(F.countDistinct("file_path").alias("files"))


def with_pattern(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.array_contains("patterns", pattern))


def clusters(files: DataFrame) -> DataFrame:
    """Files and lines of each cluster; files without one as ``uncategorized``."""
    key = F.when(blank(F.col("cluster")), "uncategorized").otherwise(F.col("cluster"))
    return files.groupBy(key.alias("cluster")).agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))


def tier(loc: Column) -> Column:
    """tiny, small, medium, large or huge by lines; small where the number makes no sense."""
    odd = loc.isNull() | F.isnan(loc.cast("double")) | (loc <= 0) | (loc.cast("double") == float("inf"))
    return F.when(odd, "small").when(loc <= 50, "tiny").when(loc <= 200, "small").when(loc <= 600, "medium").when(loc <= 1500, "large").otherwise("huge")


def completeness(files: DataFrame, *, filled: str = "filled", loc: str = "loc") -> DataFrame:
    """Tier by lines, the share of the tier's required fields and of all fields that are filled."""
    t = tier(F.col(loc))
    out = F.lit(0.0)
    for name, fields in REQUIRED.items():
        share = F.size(F.array_intersect(F.array(*map(F.lit, fields)), F.col(filled))) / len(fields)
        out = F.when(t == name, share).otherwise(out)
    every = F.size(F.array_intersect(F.array(*map(F.lit, FIELDS)), F.col(filled))) / len(FIELDS)
    return files.select("id", t.alias("tier"), F.round(out, 6).alias("required_fill"), F.round(every, 6).alias("overall_fill"))


def filled_fields(files: DataFrame) -> DataFrame:
    """``files`` with the names of the fields that hold something."""
    have = [F.when(~blank(F.col(c)), c) for c in ("purpose", "blurb")] + [F.when(F.size(c) > 0, c) for c in ("tags", "patterns", "hazards")]
    return files.withColumn("filled", F.array_compact(F.array(*have)))


def smells(files: DataFrame, degrees: DataFrame, churn: DataFrame, cycles: DataFrame, *, least: int = 3) -> DataFrame:
    """Severity 0..10 of each file by points for lines, coupling, cycles, churn and hazards; those of at least ``least``."""
    rows = files.select("file_path", "loc", F.size("hazards").alias("n_hazards")).join(degrees, "file_path", "left").join(churn, "file_path", "left").join(cycles, "file_path", "left").fillna(0)
    points = lambda c, *steps: sum((F.when(F.col(c) > above, p).otherwise(0) for above, p in steps), F.lit(0))
    severity = points("loc", (500, 2), (1000, 2)) + points("coupling", (20, 3), (40, 1)) + points("cycle_size", (1, 3), (4, 1)) + points("churn", (5, 2), (10, 1)) + points("n_hazards", (3, 2), (6, 1))
    return rows.withColumn("severity", F.least(F.lit(10), severity)).where(F.col("severity") >= least).select("file_path", "severity")


#: Weights of the parts of a file's risk.
RISK = {"hazards": 0.28, "fan_in": 0.20, "fan_out": 0.12, "churn": 0.18, "breaking": 0.10, "loc": 0.07, "stale": 0.05}


def hotspots(files: DataFrame, degrees: DataFrame, churn: DataFrame, *, limit: int = 20, weights: dict[str, float] = RISK) -> DataFrame:
    """Files by risk: each part scaled to 0..1, by a fixed number or the greatest of all files; with the three strongest parts.

    The greatest values are one row, joined by broadcast.
    """
    rows = files.select("file_path", "loc", F.size("hazards").alias("n_hazards"), "stale_days").join(degrees, "file_path", "left").join(churn, "file_path", "left")
    rows = rows.fillna(0)
    most = rows.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"most_{c}") for c in ("fan_in", "fan_out", "churn")))
    rows = rows.join(F.broadcast(most))
    one = lambda c, by: F.least(F.col(c) / by, F.lit(1.0))
    parts = {
        "hazards": one("n_hazards", 5), "fan_in": one("fan_in", F.col("most_fan_in")), "fan_out": one("fan_out", F.col("most_fan_out")), "churn": one("churn", F.col("most_churn")),
        "breaking": one("breaking", 3), "loc": one("loc", 800), "stale": one("stale_days", 30),
    }
    given = F.array(*(F.struct((-F.round(weights[n] * v, 9)).alias("o"), F.lit(n).alias("name")) for n, v in parts.items()))
    reasons = F.transform(F.slice(F.filter(F.array_sort(given), lambda r: r["o"] < 0), 1, 3), lambda r: r["name"])
    total = sum((weights[n] * v for n, v in parts.items()), F.lit(0.0))
    return rows.select("file_path", F.round(total, 9).alias("risk"), F.array_join(reasons, ",").alias("reasons")).orderBy(F.desc("risk"), "file_path").limit(limit)


def missing_fields(files: DataFrame) -> DataFrame:
    """Files that lack something, and what."""
    lacks = [F.when(blank(F.col(c)), c) for c in ("purpose", "blurb")] + [F.when(F.size(c) == 0, c) for c in ("tags", "patterns", "hazards")]
    return files.select("id", F.array_join(F.array_compact(F.array(*lacks)), ",").alias("missing")).where("missing <> ''")


def staleness(files: DataFrame, current: DataFrame) -> DataFrame:
    """pruned, stale, incomplete or complete, by the current hashes (file_path, hash)."""
    both = files.select("file_path", "file_hash", "purpose").join(current.select("file_path", F.col("hash").alias("now")), "file_path", "left")
    state = F.when(F.col("now").isNull(), "pruned").when(~F.col("now").eqNullSafe(F.col("file_hash")), "stale").when(blank(F.col("purpose")), "incomplete").otherwise("complete")
    return both.select("file_path", state.alias("state"))


def worktree(snapshots: DataFrame, disk: DataFrame) -> DataFrame:
    """clean, modified, deleted or untracked: files (file_path, hash) of the last snapshot against the disk."""
    both = snapshots.select("file_path", F.col("hash").alias("was")).join(disk.select("file_path", F.col("hash").alias("now")), "file_path", "full")
    state = F.when(F.col("was").isNull(), "untracked").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "clean").otherwise("modified")
    return both.select("file_path", state.alias("state"))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The table after the source's rows replaced or joined it; ``columns`` names those that are overwritten, all by default."""
    columns = [c for c in (columns or target.columns) if c not in key]
    new = source.select(*key, *(F.col(c).alias(f"_{c}") for c in target.columns if c not in key), F.lit(True).alias("_new"))
    old = target.withColumn("_old", F.lit(True))
    both = old.join(new, list(key), "full")
    value = lambda c: F.when(F.col("_old").isNull() | (F.col("_new") & F.lit(c in columns)), F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*(F.col(c) if c in key else value(c).alias(c) for c in target.columns))


def merge_missing(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target and the source's rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*key).distinct(), list(key), "left_anti"))


def fill_empty(target: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The target with blank text and empty arrays of some columns taken from the source, where that has something."""
    arrays = {c for c, t in target.dtypes if t.startswith("array")}
    empty = lambda c, as_: (F.coalesce(F.size(c), F.lit(0)) <= 0) if as_ in arrays else blank(c)
    new = source.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = target.join(new, key, "left")
    take = {c: F.when(empty(F.col(c), c) & ~empty(F.col(f"_{c}"), c), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(take).select(*target.columns)


def without_files(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("file_path").distinct(), "file_path", "left_anti")


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose content differs from the one before on the same file."""
    w = Window.partitionBy("file_path").orderBy("created_at", "id")
    return snapshots.withColumn("before", F.lag("hash").over(w)).where(~F.col("hash").eqNullSafe(F.col("before"))).drop("before")


def prune(snapshots: DataFrame, keep: int = 10) -> DataFrame:
    w = Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id"))
    return snapshots.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("place")


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new files added once each, unless they are pending already."""
    return queue.unionByName(new.dropDuplicates(["file_path"]).join(queue.where("status = 'pending'").select("file_path"), "file_path", "left_anti"))


def hazard_sync(files: DataFrame, plain: str, ranged: str) -> DataFrame:
    """Both hazard columns with what only the other one had, and how much that was."""
    a, b = F.col(plain), F.col(ranged)
    return files.select(
        "id",
        F.array_join(F.concat(a, F.array_except(b, a)), ",").alias("hazards"),
        F.array_join(F.concat(b, F.array_except(a, b)), ",").alias("ranged"),
        F.size(F.array_except(b, a)).alias("added_plain"),
        F.size(F.array_except(a, b)).alias("added_ranged"),
    )


def extract_imports(files: DataFrame, *, content: str = "content") -> DataFrame:
    """(file_path, specifier): distinct relative import specifiers of a source text."""
    found = F.regexp_extract_all(content, F.lit(r"""(?:from|import|require\()\s*['"](\.{1,2}/[^'"]+)['"]"""), 1)
    return files.select("file_path", F.explode(F.array_distinct(found)).alias("specifier"))


def extract_exports(files: DataFrame, *, content: str = "content") -> DataFrame:
    """(file_path, kind, name): exported functions, classes, constants, interfaces, types and enums."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?((?:function|class|const|let|var|interface|type|enum)\s*\*?\s+[A-Za-z_$][\w$]*)"), 1)
    rows = files.select("file_path", F.explode(F.array_distinct(found)).alias("e"))
    return rows.select("file_path", F.regexp_extract("e", r"^(\w+)", 1).alias("kind"), F.regexp_extract("e", r"([A-Za-z_$][\w$]*)$", 1).alias("name"))


def resolved_path(folder: Column, specifier: Column) -> Column:
    """A relative path from a folder, by a fold over its parts; null where it climbs above the root."""
    parts = F.filter(F.split(F.concat(folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    up = lambda held: F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda held, part: F.when(part == "..", up(held)).otherwise(F.concat(held, F.array(part))))
    return F.array_join(folded, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, specifier, target_file): relative specifiers against the files there are; the first candidate that exists wins."""
    plain = resolved_path(F.regexp_replace("file_path", "[^/]*$", ""), F.col("specifier"))
    rows = imports.select(F.col("file_path").alias("source_file"), "specifier", plain.alias("plain")).where("plain is not null").distinct()
    plain, stem = F.col("plain"), F.regexp_replace("plain", r"\.js$", "")
    ends = [plain, *(F.concat(plain, F.lit(end)) for end in (".ts", ".tsx", "/index.ts", "/index.tsx"))]
    scripts = [F.concat(stem, F.lit(end)) for end in (".tsx", ".ts")]
    candidates = F.when(plain.endswith(".js"), F.array(*scripts, *ends)).otherwise(F.array(*ends))
    rows = rows.select("source_file", "specifier", F.posexplode(candidates).alias("pos", "target_file"))
    known = rows.join(files.select(F.col("file_path").alias("target_file")).distinct(), "target_file")
    return known.groupBy("source_file", "specifier").agg(F.min_by("target_file", "pos").alias("target_file"))


def symbol_usages(files: DataFrame, symbols: DataFrame, *, content: str = "content") -> DataFrame:
    """(symbol, file_path, used_in, matches): whole-word occurrences of symbols (name, file_path) in other files, in one pass over the texts.

    Words that name no symbol are dropped before anything is shuffled where the names are at most ``BROADCAST_NAMES``, else by a join before they are counted;
    words shorter or longer than all names never leave their text.
    """
    words = F.regexp_extract_all(content, F.lit(r"([A-Za-z_$][\w$]*)"), 1)
    names = symbols.where("name is not null").select("name", "file_path").distinct()
    asked = cut(names.select("name").distinct())
    number, least, most = asked.agg(F.count("*"), F.min(F.length("name")), F.max(F.length("name"))).first()
    fits = F.filter(words, lambda w: F.length(w).between(F.lit(least), F.lit(most)))
    said = files.select(F.col("file_path").alias("used_in"), F.explode(fits).alias("name"))
    said = said.join(F.broadcast(asked) if number <= BROADCAST_NAMES else asked, "name", "left_semi")
    counts = said.groupBy("name", "used_in").agg(F.count("*").alias("matches"))
    return counts.join(names, "name").where("used_in <> file_path").select(F.col("name").alias("symbol"), "file_path", "used_in", "matches")


def chunk_lines(files: DataFrame, *, lines: int = 80, chars: int = 2400, least: int = 20, overlap: int = 12, step: int = 5) -> DataFrame:
    """(id, start_line, end_line, content): overlapping windows of lines, shrunk while they hold too many characters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(id=pa.int64(), start_line=pa.int32(), end_line=pa.int32(), content=pa.string())
        for batch in batches:
            for start, end in slices(batch.columns[1:]):
                out = []
                for key, text in zip(*(c.slice(start, end - start).to_pylist() for c in batch.columns)):
                    own, at = (text or "").split("\n"), 0
                    while at < len(own):
                        size = min(lines, len(own) - at)
                        while size > least and sum(map(len, own[at : at + size])) + size - 1 > chars:
                            size = max(least, size - step)
                        body = "\n".join(own[at : at + size])
                        if body.strip():
                            out.append((key, at + 1, at + size, body))
                        if at + size >= len(own):
                            break
                        at += max(1, size - overlap)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds.values())], names=list(kinds))

    return files.select(F.col("id").cast("long"), "content").mapInArrow(cut, "id long, start_line int, end_line int, content string")


#: Lines that a diff looks ahead, the one it stands at included. Fixed value.
LOOKAHEAD = 20


def _edits(old: list[str], new: list[str]) -> Iterator[str]:
    """The lines of both texts in order, marked: a line that the other text has shortly after counts as moved past, the nearer one first."""

    def ahead(lines: list[str], at: int, line: str) -> int:
        """How far on the line is, 0 if it isn't near."""
        try:
            return lines.index(line, at + 1, at + LOOKAHEAD) - at
        except ValueError:
            return 0

    i = j = 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            yield " " + old[i]
            i, j = i + 1, j + 1
            continue
        added, removed = ahead(new, j, old[i]), ahead(old, i, new[j])
        if not added and not removed:
            added = removed = 1
        elif added and removed:
            added, removed = (added, 0) if added <= removed else (0, removed)
        yield from ("-" + line for line in old[i : i + removed])
        yield from ("+" + line for line in new[j : j + added])
        i, j = i + removed, j + added
    yield from ("-" + line for line in old[i:])
    yield from ("+" + line for line in new[j:])


def greedy_diff(old: list[str], new: list[str], context: int = 3) -> tuple[str, int, int]:
    """(unified hunks, insertions, deletions). Changes more than twice the context apart are hunks of their own.

    A hunk that another follows shows one line less after its last change than before its first.
    """
    lines = list(_edits(old, new))
    changes = [k for k, line in enumerate(lines) if line[0] != " "]
    if not changes:
        return "", 0, 0
    breaks = [k for k in range(1, len(changes)) if changes[k] - changes[k - 1] > 2 * context]
    seen_old, seen_new = ([0, *itertools.accumulate(line[0] != other for line in lines)] for other in "+-")
    out = []
    for first, end in zip([0, *breaks], [*breaks, len(changes)], strict=True):
        start = max(0, changes[first] - context)
        stop = min(len(lines), changes[end - 1] + context + (end == len(changes)))
        out.append(f"@@ -{seen_old[start] + 1},{seen_old[stop] - seen_old[start]} +{seen_new[start] + 1},{seen_new[stop] - seen_new[start]} @@")
        out += lines[start:stop]
    added = sum(lines[k][0] == "+" for k in changes)
    return "\n".join(out), added, len(changes) - added


def unified_diffs(pairs: DataFrame, *, context: int = 3) -> DataFrame:
    """(id, diff, insertions, deletions) of text pairs (id, old, new): a greedy walk with a bounded look ahead, in time linear in the lines.

    Texts leave a batch in slices by bytes, so the lines and diffs of one slice are all that a task holds besides it.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(id=pa.int64(), diff=pa.string(), insertions=pa.int64(), deletions=pa.int64())
        for batch in batches:
            for start, end in slices(batch.columns[1:]):
                key, *texts = batch.slice(start, end - start).columns
                found = [greedy_diff(*((t.as_py() or "").split("\n") for t in pair), context) for pair in zip(*texts, strict=True)]
                yield pa.RecordBatch.from_arrays([key, *(pa.array(c, kind) for c, kind in zip(zip(*found), [*kinds.values()][1:]))], names=list(kinds))

    return pairs.select(F.col("id").cast("long"), "old", "new").mapInArrow(compare, "id long, diff string, insertions long, deletions long")


def diff_stats(pairs: DataFrame) -> DataFrame:
    """Lines of each text that the other lacks, as multisets: an order-free bound of what a diff shows."""
    line = lambda c, sign: pairs.select("id", F.explode(F.split(c, "\n")).alias("line"), F.lit(sign).alias("n"))
    net = line("old", -1).unionByName(line("new", 1)).groupBy("id", "line").agg(F.sum("n").alias("n"))
    return net.groupBy("id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def highlight_overlap(highlights: DataFrame, changed: DataFrame) -> DataFrame:
    """Highlights (file_path, label, start_line, end_line) that hold a changed line (file_path, line), with how many."""
    both = highlights.join(changed.distinct(), "file_path").where("line between start_line and end_line")
    return both.groupBy("file_path", "label", "start_line", "end_line").agg(F.count("*").alias("lines"))
