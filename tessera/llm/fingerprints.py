"""Canonical exact digests of documents: equal after Unicode, case and white-space folding.

Everything is DataFrame and SQL expressions. The canonical text is the NFKC form (ICU, which Spark
ships for its collations) with case folded by ``lower(upper())``, normalised again, and runs of white space made one
space. Two seeded xxhash64 values give a 128-bit bucket; where a bucket holds more than one text,
the canonical bytes are compared, and texts that differ in one bucket are told apart by their SHA-256.

Defined results: a null text counts as empty; repeated rows and ties keep a row each and equal digests;
an empty table gives an empty result; other columns pass untouched or are ignored. A null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import checkpointed, partitions

SALT = "second half"

#: Up to so many keys of repeated buckets (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000


def canonical(text: Column) -> Column:
    normal = lambda t: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.expr("true"))
    folded = normal(F.lower(F.upper(normal(F.coalesce(text, F.lit(""))))))  # folding may take letters apart that have a form of their own
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(SALT), canon)


def _hex(high: Column, low: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (high, low))))


def colliding_buckets(docs: DataFrame, *, text: str = "text") -> DataFrame | None:
    """The (high, low) buckets that hold different canonical texts; None where there are none.

    Buckets are counted from hashes alone; bytes are read again only for rows in repeated buckets, and
    are reduced to a least and a greatest text for each bucket before they are shuffled.
    """
    canon = docs.select(canonical(F.col(text)).alias("canon"))
    high, low = wide_hash(F.col("canon"))
    hashed = canon.select(high.alias("high"), low.alias("low"), "canon")
    repeated = hashed.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low").persist()
    keys = repeated.count()
    inside = hashed.join(F.broadcast(repeated) if keys <= BROADCAST_KEYS else repeated, ["high", "low"], "left_semi")
    differ = inside.groupBy("high", "low").agg(F.min("canon").alias("a"), F.max("canon").alias("z")).where("a <> z").select("high", "low").persist()
    found = differ.count()
    repeated.unpersist()
    return differ if found else None


def fingerprint_column(high: str, low: str, sha: Column, collides: Column | None) -> Column:
    base = _hex(F.col(high), F.col(low))
    return base if collides is None else F.when(collides, F.concat(base, F.lit("-"), sha)).otherwise(base)


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``: equal for two rows exactly if their canonical texts are equal."""
    high, low = wide_hash(F.col("canon"))
    row = F.struct(*docs.columns)  # columns of any name stay apart from those made here
    rows = docs.select(row.alias("row"), canonical(F.col(text)).alias("canon")).withColumns({"high": high, "low": low})
    clash = colliding_buckets(docs, text=text)
    if clash is not None:
        rows = rows.join(clash.withColumn("clash", F.lit(True)), ["high", "low"], "left")
    out = fingerprint_column("high", "low", F.sha2("canon", 256), None if clash is None else F.coalesce("clash", F.lit(False)))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "fingerprint"), out.alias("fingerprint"))


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, group_id): the least key of the documents with the same canonical text."""
    ids = fingerprints(docs.select(key, text), text=text).select(key, "fingerprint")
    least = ids.groupBy("fingerprint").agg(F.min(key).alias("group_id"))
    return ids.join(least, "fingerprint").select(key, "fingerprint", "group_id")


def with_next(rows: DataFrame, key: str, carry: list[str], tie: str, *, buckets: int) -> DataFrame:
    """Adds ``next_<c>`` for each column of ``carry``: its value in the row after, in ascending key order; the first after the last.

    The rows are dealt by ranges whose lower ends are keys that occur (at most ``buckets`` numbers on the
    driver), so no range is empty; the first row of each range is sent to the range before it as well.
    """
    points = [i / buckets for i in range(buckets + 1)]
    got = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, points, 50 * buckets).alias("ends")).first()
    ends = sorted({got["least"], *(got["ends"] or [])} - {None})
    if not ends:
        ends = [0]
    # two levels, so that a row meets about twice the root of the number of ranges
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    tops, nested = F.lit([g[0] for g in groups]), F.lit([g + [None] * (step - len(g)) for g in groups])
    value = F.coalesce(F.col(key), F.lit(ends[0]))
    reached = lambda a: F.size(F.filter(a, lambda e: e <= value))
    top = F.greatest(reached(tops), F.lit(1))
    place = (top - 1) * step + F.greatest(reached(F.element_at(nested, top)), F.lit(1)) - 1
    placed = rows.withColumn("_range", place)
    starts = F.col(key).isNull() | F.array_contains(F.element_at(nested, F.floor(F.col("_range") / step).cast("int") + 1), F.col(key))
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(F.col("_range") - 1, F.lit(len(ends))).alias("at"), F.lit(1).alias("extra"))
    copies = placed.withColumn("_copy", F.explode(F.when(starts, F.array(own, before)).otherwise(F.array(own))))
    window = Window.partitionBy("_copy.at").orderBy("_copy.extra", F.col(key).asc_nulls_first(), tie)
    ahead = copies.withColumns({f"next_{c}": F.lead(c).over(window) for c in carry})
    return ahead.where("_copy.extra = 0").drop("_copy", "_range")


def edit_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Each document against an edited form of itself and against the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the
    next document in ascending key order. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. An exact digest knows likeness 1.0 (same canonical
    bytes, compared where the hashes agree) and 0.0. Rows of equal key are ordered by their text.

    Documents that share a bucket are compared by their bytes. Edited texts exist only within this job, so
    those that share one with each other or with a document are compared by the SHA-256 of their bytes.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    clash = colliding_buckets(rows, text="text")
    spread = buckets or min(4096, 4 * partitions(docs.sparkSession))
    rows = with_next(rows, key, ["text"], "text", buckets=spread)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))})
    for name in ("text", "edited", "next_text"):
        rows = rows.withColumn(f"{name}_canon", canonical(F.col(name)))
    hashes = {}
    for name in ("text", "edited", "next_text"):
        hashes[f"{name}_high"], hashes[f"{name}_low"] = wide_hash(F.col(f"{name}_canon"))
    rows = rows.withColumns(hashes)
    same = lambda other: ((F.col("text_high") == F.col(f"{other}_high")) & (F.col("text_low") == F.col(f"{other}_low")) & (F.col("text_canon") == F.col(f"{other}_canon"))).cast("double")
    rows = checkpointed(
        rows.select(
            key, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), same("edited").alias("near_edited"), same("next_text").alias("near_next"),
            *(c for name in ("text", "edited") for c in (f"{name}_high", f"{name}_low", F.sha2(f"{name}_canon", 256).alias(f"{name}_sha"))),
        )
    )
    both = rows.select(F.explode(F.array(*(F.struct(*(F.col(f"{name}_{c}").alias(c) for c in ("high", "low", "sha"))) for name in ("text", "edited")))).alias("b"))
    differ = both.groupBy("b.high", "b.low").agg(F.min("b.sha").alias("a"), F.max("b.sha").alias("z")).where("a <> z").select("high", "low")
    clash = differ if clash is None else differ.union(clash).distinct()
    marks = {"text": None, "edited": None}
    if not clash.isEmpty():
        for name in marks:
            rows = rows.join(clash.select(F.col("high").alias(f"{name}_high"), F.col("low").alias(f"{name}_low"), F.lit(True).alias(f"{name}_clash")), [f"{name}_high", f"{name}_low"], "left")
            marks[name] = F.coalesce(f"{name}_clash", F.lit(False))
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        *(fingerprint_column(f"{name}_high", f"{name}_low", F.col(f"{name}_sha"), mark).alias(column) for (name, mark), column in zip(marks.items(), ("fingerprint", "edited_fingerprint"), strict=True)),
        "near_edited",
        "near_next",
    )
