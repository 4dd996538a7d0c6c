"""Formats, patterns and scalar rules of contract values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that contracts must agree on.
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
SHA256 = r"^[0-9a-f]{64}$"
SHA1 = r"^[0-9a-f]{40}$"
SEMVER = r"^\d+\.\d+\.\d+$"
SCHEMA_VERSION = r"^\d+\.\d+$"
PASCAL_CASE = r"^[A-Z][A-Za-z0-9]*$"
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def matches(value: Column, pattern: str) -> Column:
    """Whether the value begins with the pattern (Spark's rlike alone would find it anywhere)."""
    return value.rlike(f"^(?:{pattern})")


def instant(value: Column) -> Column:
    """The time that an ISO-8601 text names; null for anything else."""
    return F.when(value.rlike(_ISO), F.try_to_timestamp(value))


def has_format(value: Column, kind: str | None) -> Column:
    """uuid and date-time are checked; any other format holds for every text."""
    if kind == "uuid":
        return value.rlike(UUID)
    if kind == "date-time":
        return instant(value).isNotNull()
    return F.lit(True)


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name: bits of the SHA-1 of the namespace's bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def tokens(value: Column, least: int = 1) -> Column:
    """Lower-case alphanumeric tokens of at least so many characters."""
    return F.regexp_extract_all(F.lower(value), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def three_part_version(value: Column) -> Column:
    """A version of exactly three segments: cut off or filled with zeros."""
    return F.concat_ws(".", F.slice(F.concat(F.split(value, r"\."), F.array(F.lit("0"), F.lit("0"))), 1, 3))


def leading_version(value: Column, k: int) -> Column:
    """The first k segments of a version."""
    return F.substring_index(value, ".", k)


def normal_field_path(value: Column) -> Column:
    """A field path without indexes, spaces and stray dots."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\[(?:\d+|\*)?\]", ""), " ", "")
    return F.regexp_replace(F.regexp_replace(plain, r"\.\.+", "."), r"^\.+|\.+$", "")


def ancestors(path: Column) -> Column:
    """A dotted path and all paths that it lies in."""
    parts = F.split(path, r"\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "."))


def path_matches(failing: Column, field: Column, how: str = "below") -> Column:
    """exact; below: the failing path is the field or lies in it; either: one lies in the other."""
    below = (failing == field) | failing.startswith(F.concat(field, F.lit(".")))
    if how == "exact":
        return failing == field
    return below if how == "below" else below | field.startswith(F.concat(failing, F.lit(".")))
