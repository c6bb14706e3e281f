"""What can be said of source files and their history from text and joins: exports, usages, gaps, endpoints, status lines."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.text import slug
from tessera.sources.shared import slices

#: The forms of an export and the kind of each.
EXPORTS = {
    "function": r"export\s+(?:async\s+)?function\s+(\w+)",
    "class": r"export\s+class\s+(\w+)",
    "interface": r"export\s+interface\s+(\w+)",
    "type": r"export\s+type\s+(\w+)",
    "const": r"export\s+const\s+(\w+)",
    "enum": r"export\s+enum\s+(\w+)",
}


def exports(files: DataFrame, *, content: str = "content") -> DataFrame:
    """(file_path, name, type) of every export, the default one named ``default``."""
    typed = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"))
    named = [F.transform(F.regexp_extract_all(content, F.lit(pattern), 1), typed(kind)) for kind, pattern in EXPORTS.items()]
    default = F.when(F.col(content).rlike(r"export\s+default"), F.array(F.struct(F.lit("default").alias("name"), F.lit("default").alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    return files.select("file_path", F.explode(F.concat(*named, default)).alias("e")).select("file_path", "e.name", "e.type")


#: The forms of an exported symbol, the first that names it counts; names in braces come last.
SYMBOLS = {
    "function": r"\bexport\s+(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
    "class": r"\bexport\s+class\s+([A-Za-z_$][\w$]*)",
    "interface": r"\bexport\s+interface\s+([A-Za-z_$][\w$]*)",
    "type": r"\bexport\s+type\s+([A-Za-z_$][\w$]*)",
    "enum": r"\bexport\s+enum\s+([A-Za-z_$][\w$]*)",
    "value": r"\bexport\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)",
    "namespace": r"\bexport\s+namespace\s+([A-Za-z_$][\w$]*)",
}


def exported_symbols(files: DataFrame, *, content: str = "content") -> DataFrame:
    """(file_path, name, type): each exported name once, under the name it is known by outside."""
    typed = lambda kind: lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"))
    named = [F.transform(F.regexp_extract_all(content, F.lit(pattern), 1), typed(kind)) for kind, pattern in SYMBOLS.items()]
    inside = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(r"\bexport\s*\{([^}]+)\}"), 1), lambda b: F.split(b, ",")))
    outer = F.transform(inside, lambda e: F.trim(F.regexp_replace(e, r"(?is)^.*\s+as\s+", "")))
    rows = files.select("file_path", F.posexplode(F.concat(*named, F.transform(outer, typed("re-export")))).alias("place", "e"))
    first = rows.where("trim(e.name) not in ('', 'default')").groupBy("file_path", F.trim("e.name").alias("name")).agg(F.min_by("e.type", "place").alias("type"))
    return first


def reference_edge(usage: Column) -> Column:
    """The kind of edge that a described usage makes."""
    plain = F.lower(F.trim(usage))
    has = lambda word: F.contains(plain, F.lit(word))
    # The words that tell a kind, and their order.
    return F.when(has("type"), "type_ref").when(has("re-export") | has("reexport"), "reexport").when(has("config"), "config_ref").otherwise("runtime_call")


def replaced_references(kept: DataFrame, refs: DataFrame) -> DataFrame:
    """The references after those of some files were written anew.

    ``kept`` is (source_file, name, target_file, edge_type, usage_count, confidence, provenance); ``refs`` is (file_path,
    model, sites array<struct<name, file, count double, usage_type>>). Of the files in ``refs`` only references from the
    syntax tree stay; each call site with a file becomes one.
    """
    stay = kept.join(refs.select(F.col("file_path").alias("source_file")).distinct(), "source_file", "left_semi").where("provenance = 'ast'")
    other = kept.join(refs.select(F.col("file_path").alias("source_file")).distinct(), "source_file", "left_anti")
    llm = F.coalesce(F.col("model") != "heuristic", F.lit(False)) & (F.coalesce("model", F.lit("")) != "")
    rows = refs.select("file_path", llm.alias("llm"), F.explode("sites").alias("s")).where("trim(s.file) <> '' and trim(s.name) <> ''")
    new = rows.select(
        F.col("file_path").alias("source_file"), F.trim("s.name").alias("name"), F.trim("s.file").alias("target_file"), reference_edge(F.coalesce("s.usage_type", F.lit(""))).alias("edge_type"),
        F.greatest(F.lit(1).cast("long"), F.coalesce(F.floor("s.count"), F.lit(1).cast("long"))).alias("usage_count"), F.when(F.col("llm"), 0.8).otherwise(0.6).alias("confidence"), F.when(F.col("llm"), "llm").otherwise("inferred").alias("provenance"),
    )
    return other.unionByName(stay).unionByName(new)


def healed_highlights(files: DataFrame, column: str = "source_highlights") -> DataFrame:
    """(file_path, highlights, removed): JSON highlights without the entries that say nothing or have no place, numbered anew if any went.

    What is no array at all becomes an empty one and counts as one entry removed.
    """
    entries = F.from_json(column, "array<struct<id:double,label:string,startLine:double,endLine:double,content:string>>")
    fine = lambda h: F.coalesce((F.trim(h["content"]) != "") & (h["startLine"] >= 1) & (h["endLine"] >= 1) & (h["id"] >= 1), F.lit(False))
    rows = files.select("file_path", F.coalesce(entries, F.array().cast("array<struct<id:double,label:string,startLine:double,endLine:double,content:string>>")).alias("all"), F.startswith(F.ltrim(column), F.lit("[")).alias("array"))
    rows = rows.withColumn("valid", F.filter("all", fine)).withColumn("removed", F.when(F.col("array"), F.size("all") - F.size("valid")).otherwise(1))
    numbered = F.transform("valid", lambda h, i: h.withField("id", (i + 1).cast("double")))
    return rows.select("file_path", F.when(F.col("removed") > 0, numbered).otherwise(F.col("all")).alias("highlights"), "removed")


def usage_type(symbol: Column, lines: Column) -> Column:
    """How the lines use the symbol; the first form that holds counts."""
    quoted = F.concat(F.lit(r"\Q"), symbol, F.lit(r"\E"))
    holds = lambda before, after: F.regexp_like(lines, F.concat(F.lit(before), quoted, F.lit(after)))
    # The forms of a use and their order.
    return (
        F.when(lines.rlike(r"\bfrom\s+['\"][^'\"]*['\"]") & F.contains(lines, symbol), "import")
        .when(holds(r"\bexport\s*\{[^}]*\b", r"\b[^}]*\}"), "re-export")
        .when(holds(r"\bnew\s+", r"\b") | holds(r"\b", r"\s*\("), "call")
        .when(holds(r"\btypeof\s+", r"\b") | holds(r":\s*", r"\b"), "type-reference")
        .otherwise("reference")
    )


def dead_exports(exported: DataFrame, sites: DataFrame, reachable: DataFrame) -> DataFrame:
    """(file_path, name, reason) of reachable files' exports that no reachable file uses.

    ``sites`` is (file_path, name, site, count): where a known symbol is used, with a null site for symbols that
    are known and never used. ``reachable`` is (file_path).
    """
    live = reachable.select(F.col("file_path").alias("site"), F.lit(True).alias("live"))
    marked = sites.join(live, "site", "left")
    used = marked.groupBy("file_path", "name").agg(F.sum(F.when(F.col("live"), F.col("count")).otherwise(0)).alias("uses"), F.count("site").alias("places"))
    own = exported.select("file_path", "name").distinct().join(reachable.select("file_path").distinct(), "file_path", "left_semi").join(used, ["file_path", "name"], "left")
    reason = F.when(F.col("places").isNull(), "symbol missing from cross_refs").when(F.col("places") > 0, "consumers exist only in unreachable files").otherwise("no cross_ref consumers")
    return own.where("coalesce(uses, 0) = 0").select("file_path", "name", reason.alias("reason"))


def gaps(exported: DataFrame, imported: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, file_path, name): exports that no other file imports, and imports whose name its file never uses again.

    ``imported`` is (file_path, name, source): a name taken from the file ``source``. ``words`` is (file_path, name,
    count): how often a file says the name, its import included.
    """
    taken = imported.where("source <> file_path").select(F.col("source").alias("file_path"), "name").distinct()
    never = exported.select("file_path", "name").distinct().join(taken, ["file_path", "name"], "left_anti").withColumn("kind", F.lit("exported_not_referenced"))
    said = words.where("count > 1").select("file_path", "name")
    idle = imported.select("file_path", "name").distinct().join(said, ["file_path", "name"], "left_anti").withColumn("kind", F.lit("imported_not_used"))
    return never.unionByName(idle).select("kind", "file_path", "name")


def resolve_flow_calls(calls: DataFrame, symbols: DataFrame, links: DataFrame) -> DataFrame:
    """(id, target, confidence): of the symbols with the call's name, one of the same file, else of an imported file, else the first exported, else the first.

    Symbols are reduced to one for each (name, file), and one for each name, before they meet calls.
    """
    named = symbols.select("name", F.col("id").alias("target"), F.col("file_path").alias("at"), "exported")
    in_file = named.groupBy("name", "at").agg(F.min("target").alias("own"))
    rank = F.when(F.col("exported"), 2).otherwise(3)
    anywhere = named.groupBy("name").agg(F.min(F.struct(rank.alias("rank"), "target"))["target"].alias("any"))
    imported = links.select(F.col("src").alias("file_path"), F.col("dst").alias("at")).distinct()
    near = calls.select("file_path", "name").distinct().join(imported, "file_path").join(in_file, ["name", "at"]).groupBy("file_path", "name").agg(F.min("own").alias("near"))
    every = calls.select("id", "file_path", "name").join(anywhere, "name").join(in_file.withColumnRenamed("at", "file_path"), ["file_path", "name"], "left").join(near, ["file_path", "name"], "left")
    rank = F.when(F.col("own").isNotNull(), 0).when(F.col("near").isNotNull(), 1).otherwise(2)
    best = every.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), F.coalesce("own", "near", "any").alias("target")))["target"].alias("target"))
    return best.withColumn("confidence", F.lit(0.8))


def named_clusters(members: DataFrame) -> DataFrame:
    """(community, name): the slug of the directory that most of its files are in; where several share it, numbered by size.

    ``members`` is (community, file_path). Only communities, not files, meet in the numbering.
    """
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.lit("root"))
    counts = members.groupBy("community", folder.alias("dir")).agg(F.count("*").alias("n"))
    top = counts.groupBy("community").agg(F.sum("n").alias("size"), F.min_by("dir", F.struct(-F.col("n"), F.col("dir"))).alias("dir")).withColumn("slug", slug(F.col("dir")))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("size"), "community"))
    return top.select("community", F.when(place == 1, F.concat(F.lit("dir/"), "slug")).otherwise(F.concat(F.lit("dir/"), "slug", F.lit("-"), place.cast("string"))).alias("name"))


def resolve_endpoints(asked: DataFrame, changelog: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(request, changelog_id, snapshot_id, source): what a diff's endpoint stands for and which snapshot holds it.

    ``asked`` is (request, file_path, endpoint): ``latest``, ``prev``, a number, or a time. Changelog and snapshots are
    (file_path, id, at), at the changelog's ids. A snapshot of the entry itself is exact, else the last one before it is
    nearest; without any, the source is null and the caller turns to version control.
    """
    number, place = F.col("endpoint").try_cast("long"), F.when(F.col("endpoint") == "latest", 1).when(F.col("endpoint") == "prev", 2)
    requests = asked.select("request", "file_path", place.alias("back"), F.when(place.isNull(), number).alias("changelog_id"), F.when(place.isNull() & number.isNull(), F.col("endpoint").try_cast("timestamp_ntz")).alias("until"))
    entries = changelog.select("file_path", F.col("id").alias("changelog_id"), "at", F.struct("at", F.col("id").alias("id")).alias("c")).join(asked.select("file_path").distinct(), "file_path", "left_semi")
    back = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("at"), F.desc("changelog_id")))
    by_place = requests.join(entries.withColumn("back", back).where("back <= 2").select("file_path", "back", "c"), ["file_path", "back"])
    by_number = requests.join(entries.groupBy("file_path", "changelog_id").agg(F.max("c").alias("c")), ["file_path", "changelog_id"])
    by_time = _last_until(requests, entries.withColumn("found", F.col("c"))).withColumn("c", F.col("found"))
    chosen = reduce(DataFrame.unionByName, (x.select("request", "file_path", "c") for x in (by_place, by_number, by_time)))
    chosen = chosen.groupBy("request", "file_path").agg(F.max("c").alias("c")).select("request", "file_path", F.col("c.id").alias("changelog_id"), F.col("c.at").alias("until"))
    held = snapshots.select("file_path", F.col("id").alias("changelog_id"), "at", F.struct("at", F.col("id").alias("id")).alias("found"))
    exact = chosen.join(held.withColumnRenamed("at", "taken"), ["file_path", "changelog_id"]).where("taken <= until").select("request", "file_path", F.lit(True).alias("exact"), "found")
    near = _last_until(chosen, held).select("request", "file_path", F.lit(False).alias("exact"), "found")
    best = exact.unionByName(near).groupBy("request", "file_path").agg(F.max(F.struct("exact", "found")).alias("s"))
    source = F.when(F.col("s.exact"), "exact_snapshot").when(F.col("s").isNotNull(), "nearest_snapshot")
    return chosen.join(best, ["request", "file_path"], "left").select("request", "changelog_id", F.col("s.found.id").alias("snapshot_id"), source.alias("source"))


def _last_until(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(request, file_path, found): for each (request, file_path, until) the greatest ``found`` of the file's last rows (at, found), by one sorted union; none without."""
    sides = rows.where("at is not null").select("file_path", "at", F.lit(None).cast("string").alias("request"), "found")
    sides = sides.unionByName(asked.where("until is not null and request is not null").select("file_path", F.col("until").alias("at"), F.col("request").cast("string").alias("request")), allowMissingColumns=True)
    before = Window.partitionBy("file_path").orderBy("at", F.col("request").isNotNull(), "found").rowsBetween(Window.unboundedPreceding, 0)
    return sides.withColumn("found", F.last("found", ignorenulls=True).over(before)).where("request is not null and found is not null").select("request", "file_path", "found")


def _each(texts: pa.Array, make: Callable[[str], str | None]) -> pa.Array:
    """``make`` of each text, in slices by bytes: only one slice's texts are Python's at a time."""
    parts = [pa.array([None if t is None else make(t) for t in texts.slice(start, end - start).to_pylist()], pa.string()) for start, end in slices([texts])]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def packed(texts: pa.Array) -> pa.Array:
    """Gzip, then base64; the same bytes for the same text."""
    return _each(texts, lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode())


@F.arrow_udf(T.StringType())
def unpacked(texts: pa.Array) -> pa.Array:
    """The text of a packed snapshot; what isn't packed is returned as it is."""

    def one(value: str) -> str:
        try:
            return gzip.decompress(base64.b64decode(value, validate=True)).decode()
        except (ValueError, OSError, EOFError):
            return value

    return _each(texts, one)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """(file_path, id, content) of the newest snapshot of each file, unpacked."""
    last = snapshots.groupBy("file_path").agg(F.max_by(F.struct("id", "content"), F.struct("at", "id")).alias("s"))
    return last.select("file_path", "s.id", unpacked(F.col("s.content")).alias("content"))


def status_lines(lines: DataFrame) -> DataFrame:
    """(repo, state, path) of the file lines of short status output (repo, line): a path may be in several states."""
    x, y, path = F.substring("line", 1, 1), F.substring("line", 2, 1), F.substring("line", 4, 1 << 20)
    both = F.concat(x, y)
    conflict = (x == "U") | (y == "U") | both.isin("AA", "DD")
    state = lambda when, name: F.when(when, F.lit(name))
    states = F.when(conflict, F.array(F.lit("conflicted"))).when(both == "??", F.array(F.lit("untracked"))).otherwise(
        F.array_compact(F.array(state((x == "R") | (y == "R"), "renamed"), state(~x.isin(" ", "?"), "staged"), state(~y.isin(" ", "?"), "unstaged")))
    )
    own = lines.where((F.length("line") >= 3) & ~F.startswith(F.col("line"), F.lit("## ")))
    return own.select("repo", F.explode(states).alias("state"), path.alias("path"))


def status_branch(lines: DataFrame) -> DataFrame:
    """(repo, branch, ahead, behind) of the head lines of status output."""
    rest = F.expr("substring(line, 4)")
    count = lambda word: F.coalesce(F.regexp_extract(rest, rf"\[.*?{word} (\d+)", 1).try_cast("int"), F.lit(0))
    head = lines.where(F.startswith(F.col("line"), F.lit("## ")))
    return head.select("repo", F.split(F.regexp_replace(rest, r"\s*\[.*?\]\s*$", ""), r"\.\.\.")[0].alias("branch"), count("ahead").alias("ahead"), count("behind").alias("behind"))


def tool_line(name: Column, argument: dict[str, Column], *, length: int = 120) -> Column:
    """One line for a tool call; ``argument`` has its inputs by name, null where absent."""
    get = lambda k: F.coalesce(argument.get(k, F.lit(None).cast("string")), F.lit(""))
    place = argument.get("path", F.lit(None).cast("string"))
    where = F.when(F.coalesce(place, F.lit("")) != "", F.concat(F.lit(" in "), place)).otherwise("")
    first = F.coalesce(*argument.values())
    line = (
        F.when(name.isin("Read", "Edit", "Write"), F.concat(name, F.lit(" "), get("file_path")))
        .when(name == "Bash", F.concat(F.lit("Bash: "), get("command")))
        .when(name == "Grep", F.concat(F.lit("Grep /"), get("pattern"), F.lit("/"), where))
        .when(name == "Glob", F.concat(F.lit("Glob "), get("pattern")))
        .when(name == "WebSearch", F.concat(F.lit('WebSearch "'), get("query"), F.lit('"')))
        .when(name == "WebFetch", F.concat(F.lit("WebFetch "), get("url")))
        .when(name == "TodoWrite", F.lit("TodoWrite"))
        .otherwise(F.concat(name, F.when(F.coalesce(first, F.lit("")) != "", F.concat(F.lit(" "), first)).otherwise("")))
    )
    return F.substring(line, 1, length)


def search_footprint(calls: DataFrame, *, most: int = 8) -> DataFrame:
    """The last Grep and Glob calls of each session; ``back`` counts from the last."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ordinal")))
    return calls.where(F.col("name").isin("Grep", "Glob")).withColumn("back", back).where(F.col("back") <= most)


def predecessors(rows: DataFrame, *, first: int = 50) -> DataFrame:
    """(session_id, predecessor): the session that one of a session's first rows says it continues; the earliest row counts."""
    found = F.regexp_extract("text", r"\n\s*Session:\s*([0-9a-fA-F-]{8,})\s*(?:\n|$)", 1)
    said = rows.where(F.col("ordinal") < first).withColumn("p", found).where("p <> ''")
    return said.groupBy("session_id").agg(F.min_by("p", "ordinal").alias("predecessor"))


def last_snapshot_of_list(events: DataFrame, schema: str) -> DataFrame:
    """Of the events (session_id, ordinal, input) whose input parses as ``schema``, the last of each session."""
    valid = events.withColumn("parsed", F.from_json("input", schema)).where("parsed is not null and parsed.todos is not null")
    return valid.groupBy("session_id").agg(F.max_by("parsed", "ordinal").alias("parsed"), F.max("ordinal").alias("ordinal"))


def phase(current: Column, stored: Column, cross_refs: Column) -> Column:
    """none, structure or crossref: how far a file with this hash has come."""
    refs = F.from_json(cross_refs, "symbols map<string,string>, total_exports_analyzed int, crossref_timestamp string, pass2_timestamp string, crossref_model string")
    timed = refs["crossref_timestamp"].isNotNull() | refs["pass2_timestamp"].isNotNull()
    model = F.coalesce(refs["crossref_model"], F.lit(""))
    some = F.coalesce(F.size(F.map_keys(refs["symbols"])), F.lit(0)) > 0
    nothing = (F.coalesce(refs["total_exports_analyzed"], F.lit(-1)) == 0) & (model == "heuristic")
    whole = (model != "scaffold") & timed & (some | nothing)
    return F.when(stored.isNull() | (stored != current), "none").when(F.coalesce(whole, F.lit(False)), "crossref").otherwise("structure")


def idempotent_commits(new: DataFrame, kept: DataFrame) -> DataFrame:
    """Commits whose key isn't kept yet, the earliest of each key."""
    key = F.sha1(F.concat_ws("\u0000", "workspace", "file_path", "summary", "file_hash"))
    once = new.withColumn("key", key).join(kept.select("key"), "key", "left_anti")
    return once.groupBy("key").agg(F.min_by(F.struct(*new.columns), F.struct("at", "id")).alias("c")).select("key", "c.*")

