"""Column expressions on tags and query text, all JVM-side; those on arrays of parts use higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_form(tag: Column) -> Column:
    """The form of a tag: runs of space, tab, no-break space and underscore become one space,
    both ends are trimmed, letters become lower case. Null stays null; the form may be empty."""
    spelt = F.when(tag.rlike("[\\t\\u00a0_]| {2}"), F.regexp_replace(tag, "[ \\t\\u00a0_]+", " ")).otherwise(tag)
    return F.lower(F.trim(spelt))


def elements(df: DataFrame, tags: str = "tags", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row (tag, *keep) per element of `tags` that is a tag: nulls and empty forms are none.

    Every row of `df` counts, repeated rows too. Null and empty arrays give no row.
    """
    raw = df.select(*keep, F.explode(F.col(tags)).alias("tag"))
    # a form is empty if there is nothing but blanks; asked of the raw tag, so that Spark doesn't push
    # the condition below the form and work that out twice
    return raw.filter(F.col("tag").rlike("[^ \\t\\u00a0_]")).select(tag_form(F.col("tag")).alias("tag"), *keep)


def tag_forms(tags: Column) -> Column:
    """The array `tags` with its elements in their form, without those that are no tags; see `elements`."""
    return F.transform(F.filter(tags, lambda t: t.rlike("[^ \\t\\u00a0_]")), tag_form)


def split_console(text: Column) -> Column:
    """Split on commas and drop spaces after a comma only; an empty text is one empty tag."""
    return F.split(text, ", *", -1)


def split_web(text: Column) -> Column:
    """Split on commas, trim white space at both ends of each part and drop empty parts."""
    parts = F.transform(F.split(text, ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")
