"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The start and the prime of the 48-bit hash, how many code units it reads, and where each id band begins.
HASH_START, HASH_FACTOR, HASH_MASK, HASH_UNITS = 172505283306277, 435, 2**48 - 1, 4096
BANDS = {"issue_person": 10**12, "issue_project": 2 * 10**12, "issue": 3 * 10**12, "issue_comment": 4 * 10**12, "document": 5 * 2**48, "folder": 6 * 2**48, "file_person": 7 * 2**48, "entity": 8 * 2**48, "family": 9 * 2**48, "pattern": 10 * 2**48, "review": 11 * 2**48}


def hash48(text: Column) -> Column:
    """FNV-1a over the UTF-16 units of a text, modulo 2^48: the prime is 2^40 + 435, so products stay in 64 bits."""
    raw = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), F.least(F.length(raw) / 4, F.lit(HASH_UNITS)).cast("int")), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.slice(units, F.lit(1), F.size(units) - 1)
    step = lambda h, c: (F.shiftleft(h.bitwiseXOR(c).bitwiseAND(F.lit(255)), 40) + h.bitwiseXOR(c) * HASH_FACTOR).bitwiseAND(F.lit(HASH_MASK))
    return F.aggregate(units, F.lit(HASH_START).cast("long"), step)


def hex_id(prefix: str, text: Column) -> Column:
    """A prefix and the hash in lower-case hexadecimal digits without leading zeros."""
    return F.concat(F.lit(prefix), F.lower(F.hex(hash48(text))))


def person_band(id_: Column) -> Column:
    """Which source a person's id comes from; null for ids of other kinds."""
    b = BANDS
    return F.when((id_ >= 1) & (id_ < b["issue_person"]), "hr").when((id_ >= b["issue_person"]) & (id_ < b["issue_project"]), "issues").when((id_ >= b["file_person"]) & (id_ < b["entity"]), "drive")


def epoch_or_zero(text: Column) -> Column:
    """Seconds of an ISO instant; 0 for what is none."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(text)), F.lit(0)).cast("long")


def yyyymmdd(text: Column) -> Column:
    """A leading YYYY-MM-DD as an integer, else null."""
    day = F.replace(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("-"), F.lit(""))
    return F.nullif(day, F.lit("")).try_cast("int")


def trimmed(text: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def email_key(text: Column) -> Column:
    return F.nullif(F.lower(trimmed(text)), F.lit(""))


def name_tokens(name: Column) -> Column:
    """The set of a name's parts in order, in lower case."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), r"(?U)[\s.\-_]+"), lambda t: t != "")))


def snippet(text: Column, at: Column, length: Column, around: int = 40) -> Column:
    """What stands around a hit at ``at`` (from 0)."""
    first = F.greatest(at - around, F.lit(0))
    return F.substring(text, first + 1, at + length + around - first)


def visible(label: Column, mask: Column | int) -> Column:
    """Whether a clearance mask shows a label; nodes without a label are shown."""
    wide = mask if isinstance(mask, Column) else F.lit(mask)
    return label.isNull() | (F.call_function("shiftright", wide.cast("long"), label.cast("int")).bitwiseAND(F.lit(1)) == 1)


def first_name(*names: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def object_of(text: Column) -> Column:
    """The outermost JSON object in a text that may hold more, such as a fenced answer."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def skip_level(a: Column, b: Column) -> Column:
    """A name for the composition of two predicates; one with itself skips a level, without what it ends in."""
    return F.when(a == b, F.concat(F.lit("skip-level-"), F.regexp_replace(a, "-of$", ""))).otherwise(F.concat_ws("-then-", a, b))
