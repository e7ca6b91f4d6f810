"""Version specs and semantic versions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import trimmed

#: A full version; a version within a spec.
SEMVER = r"^\d+\.\d+\.\d+(?:-[\w.]+)?(?:\+[\w.]+)?$"
TOKEN = r"\d+(?:\.\d+)*(?:[-+][A-Za-z0-9.+-]+)?"


def is_semver(version: Column) -> Column:
    return version.rlike(SEMVER)


def version_of(spec: Column) -> Column:
    """The first version that a loose spec names before any comma; null if it names none."""
    return F.nullif(F.regexp_extract(F.split_part(spec, F.lit(","), F.lit(1)), f"({TOKEN})", 1), F.lit(""))


def is_pinned(spec: Column, version: Column) -> Column:
    """The spec allows this one version only: it is all that is left without one or two = before it, or one pair of marks around it."""
    bare = F.regexp_replace(trimmed(spec), r"""^={1,2}(?=[^=])|^\[(.*)\]$|^"(.*)"$|^'(.*)'$""", "$1$2$3")
    return F.coalesce(bare == version, F.lit(False))


def _part(version: Column, index: int) -> Column:
    text = F.split_part(version, F.lit("."), F.lit(index))
    return F.coalesce(F.regexp_extract(text, r"^\s*(-?\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def semver_key(version: Column) -> Column:
    """A struct that orders versions by major, minor and patch; parts that aren't numbers count as 0."""
    bare = F.regexp_replace(version, r"^[v=>\s]+", "")
    return F.struct(_part(bare, 1).alias("major"), _part(bare, 2).alias("minor"), _part(bare, 3).alias("patch"))


def major_of(version: Column) -> Column:
    return _part(version, 1)
