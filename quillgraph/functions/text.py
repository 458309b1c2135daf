"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_like(column: Column | str, text: str) -> Column:
    """LIKE '%text%' without regard to case; the text's own % and _ stay wildcards, a backslash is literal."""
    column = F.col(column) if isinstance(column, str) else column
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def estimate_tokens(column: Column | str) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(column) / 4)).cast("long")


def path_depth(column: Column | str) -> Column:
    """Segments of a path; a null path has one."""
    path = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def parent_directory(column: Column | str) -> Column:
    """The true parent directory of a path, '/' for a path without one."""
    column = F.col(column) if isinstance(column, str) else column
    folder = F.regexp_extract(column, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", F.lit("/")).otherwise(folder)


def base_name(column: Column | str) -> Column:
    return F.regexp_extract(column, r"([^/]*)$", 1)


def stem(column: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(column, r"(?<=.)\.[^.]*$", "")


def commit_time(column: Column | str) -> Column:
    """The UTC time of a commit date: git's notation or ISO 8601; other notations are null."""
    column = F.col(column) if isinstance(column, str) else column
    git = F.try_to_timestamp(column, F.lit("yyyy-MM-dd HH:mm:ss Z"))
    iso = F.when(column.rlike(r"^\d{4}-\d\d-\d\dT"), F.try_to_timestamp(column, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    return F.coalesce(git, iso)


def parsed_metadata(column: Column | str) -> Column:
    """Metadata JSON as text of an object, also where it was encoded twice; null where it can't be read."""
    column = F.col(column) if isinstance(column, str) else column
    inner = F.try_variant_get(F.try_parse_json(column), "$", "string")
    text = F.when(column.startswith('"'), inner).otherwise(column)
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)
