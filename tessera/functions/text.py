"""Text normalisation, tokens and keys as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search query drops; the two lists differ by silo.
STOPWORDS_TRANSCRIPTS = frozenset(
    "a an the and or but of for to in on at by with from as is are was were be been being have has had do does did will "
    "would could should may might must can cant wont dont isnt arent wasnt werent hasnt hadnt doesnt didnt wouldnt couldnt shouldnt i me my "
    "we us our you your he she it they them this that these those there here what which who whom whose when where why how all any "
    "some no not only same so than too very".split()
)
STOPWORDS_FILES = frozenset(
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will "
    "would could should may might shall can need it its this that these those i me my we our you your he she they them their who "
    "which what where when how why if then so no not all each every any some such only about up out just into also than very too".split()
)


def normalize(text: Column) -> Column:
    """camelCase and acronyms split, runs of ``_`` and ``-`` to a space, white space collapsed."""
    out = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    out = F.regexp_replace(out, r"[_-]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def index_tokens(text: Column) -> Column:
    """The tokens of the normalised text. What else ``normalize`` does lies between tokens, so camelCase is all that is left to split."""
    return tokens(F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "))


def query_terms(query: Column, stopwords: Sequence[str]) -> Column:
    """The terms that a full-text query asks for: normalised, without stopwords and single characters."""
    spaced = F.regexp_replace(normalize(query), r"[^\p{L}\p{N}\s]", " ")
    words = F.split(F.lower(spaced), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(stopwords)))


def match_expression(query: Column, stopwords: Sequence[str], *, quoted: bool = True) -> Column:
    """The terms joined by OR; empty if none is left."""
    terms = query_terms(query, stopwords)
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))) if quoted else terms, " OR ")


def truncated(text: Column, length: int, marker: str = "…[truncated]") -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(marker))).otherwise(text)


def first_sentence(text: Column, length: int = 160) -> Column:
    """The text with white space collapsed if it is short, else its first sentence if that is, else its start."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    sentence = F.regexp_extract(plain, r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(F.length(plain) <= length, plain).when((sentence != "") & (F.length(sentence) <= length), sentence).otherwise(F.concat(F.substring(plain, 1, length), F.lit("…")))


def first_line(text: Column, length: int = 100) -> Column:
    """The first line that isn't blank, trimmed, cut with three dots; empty if there is none."""
    line = F.regexp_extract(text, r"(?m)^[^\S\n]*(\S[^\n]*?)[^\S\n]*$", 1)
    return F.when(F.length(line) <= length, line).otherwise(F.concat(F.substring(line, 1, length - 3), F.lit("...")))


def cut_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8 of a text, cut between characters, and how many bytes are left out."""
    raw = F.encode(text, "UTF-8")
    inside = lambda n: F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    end = F.lit(most)
    for back in (3, 2, 1, 0):
        end = F.when(~inside(most - back), most - back).otherwise(end)
    start = F.decode(F.substring(raw, F.lit(1), end), "UTF-8")
    cut = F.concat(start, F.lit("\n… [truncated, "), (F.octet_length(raw) - end).cast("string"), F.lit(" more bytes]"))
    return F.when(F.octet_length(raw) <= most, text).otherwise(cut)


def cut_lines(text: Column, most: int) -> Column:
    """The first lines of a text, and how many are left out."""
    lines = F.split(text, "\n")
    more = F.size(lines) - most
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n… [+"), more.cast("string"), F.when(more == 1, " line").otherwise(" lines"), F.lit(" elided]"))
    return F.when(more <= 0, text).otherwise(cut)


def clamped_line(text: Column, length: int) -> Column:
    """The text on one line, cut with three dots."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) <= length, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, length - 3)), F.lit("...")))


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def tail_path(path: Column, parts: int = 2) -> Column:
    """The last components of a path."""
    return F.substring_index(path, "/", -parts)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-+|-+$)", "")


def workspace_slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "-")


def folder_slug(path: Column) -> Column:
    """The name that a working folder's transcripts are kept under."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def coerced_boolean(text: Column) -> Column:
    """True and false written in any case; null for anything else."""
    plain = F.lower(F.trim(text))
    return F.when(plain == "true", True).when(plain == "false", False)


def coerced_integer(text: Column) -> Column:
    """A whole number, written with or without decimals that are zero; null for anything else."""
    number = F.trim(text).try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def joined_key(*parts: Column) -> Column:
    """SHA-1 of the parts joined by a zero character."""
    return F.sha1(F.concat_ws("\u0000", *parts))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def edge_type(text: Column, default: str = "unknown") -> Column:
    plain = F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")
    return F.when(plain.isNull() | (plain == ""), default).otherwise(plain)


def valid_identity(name: Column) -> Column:
    """At most 128 characters without slashes and white space, no leading hyphen, not ``.`` or ``..``."""
    return F.coalesce((F.length(name) <= 128) & name.rlike(r"^[^-/\\\s\x00][^/\\\s\x00]*$") & ~name.isin(".", ".."), F.lit(False))


def age(millis: Column) -> Column:
    """A span of time as ``Ns``, ``Nm``, ``Nh`` or ``Nd``."""
    n = lambda unit, sign: F.concat(F.floor(millis / unit).cast("string"), F.lit(sign))
    return F.when(millis < 60_000, n(1000, "s")).when(millis < 3_600_000, n(60_000, "m")).when(millis < 86_400_000, n(3_600_000, "h")).otherwise(n(86_400_000, "d"))


def cluster_of(path: Column) -> Column:
    """The cluster that a path belongs to by its directories."""
    part = lambda n: F.coalesce(F.get(F.split(path, "/"), F.lit(n)), F.lit(""))
    named = F.when(part(1) == "components", "ui").when(part(1) == "stores", "store").otherwise(part(1))  # fixed values
    deep = F.size(F.split(path, "/"))
    return (
        F.when(path.endswith(".md"), "docs")
        .when((part(0) != "src") & (part(0) != ""), F.concat(F.lit("misc-"), part(0)))
        .when(part(0) != "src", "root")
        .when(deep <= 2, "core")
        .when((part(1) == "app") & (part(2) == "api") & (part(3) != ""), F.concat(F.lit("api-"), part(3)))
        .when((part(1) == "app") & (part(2) != ""), F.concat(F.lit("page-"), part(2)))
        .when(part(1) == "app", "page")
        .when(part(2) != "", F.concat_ws("-", named, part(2)))
        .otherwise(named)
    )


def clamp_text(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def monday_week(day: Column) -> Column:
    """Year and week, weeks starting on Monday, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7).cast("string")
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))
