"""Texts that stand for registry entities in an embedding index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _some(value: Column, before: str = "", after: str = "") -> Column:
    """The value between two strings; null where it is empty, so that joins leave it out."""
    plain = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.concat(F.lit(before), plain, F.lit(after))


def _list(values: Column, most: int, separator: str, before: str, after: str = ".") -> Column:
    held = F.slice(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != ""), 1, most)
    return F.when(F.size(held) > 0, F.concat(F.lit(before), F.array_join(held, separator), F.lit(after)))


def person(name: Column, role: Column, institution: Column, bio: Column, topics: Column, titles: Column, h_index: Column, cited_by: Column) -> Column:
    first = F.concat(F.coalesce(name, F.lit("Unknown")), F.lit(" is a "), F.coalesce(role, F.lit("")), F.coalesce(_some(institution, " at "), F.lit("")), F.lit("."))
    about = F.when(F.length(bio) > 500, F.concat(F.left(bio, F.lit(500)), F.lit("..."))).otherwise(F.nullif(bio, F.lit("")))
    measures = F.when(h_index > 0, F.concat(F.lit("h-index: "), h_index.cast("string"), F.lit(", cited by: "), F.coalesce(cited_by, F.lit(0)).cast("string"), F.lit(".")))
    return F.concat_ws(" ", first, about, _list(topics, 10, ", ", "Research areas: "), _list(titles, 5, "; ", "Recent publications: "), measures)


def dataset(name: Column, description: Column, form: Column, size_gb: Column, location: Column, access: Column, source: Column, tags: Column) -> Column:
    return F.concat_ws(
        " ", F.concat(F.coalesce(name, F.lit("Unknown Dataset")), F.lit(".")), F.nullif(description, F.lit("")), _some(form, "Format: ", "."), _some(size_gb, "Size: ", " GB."), _some(location, "Location: ", "."), _some(access, "Access: ", "."), _some(source, "Source: ", "."), _list(tags, 20, ", ", "Tags: "),
    )


def project(name: Column, description: Column, status: Column, members: Column) -> Column:
    return F.concat_ws(" ", _some(name, "", "."), F.nullif(description, F.lit("")), _some(status, "Status: ", "."), _list(members, 20, ", ", "Team: "))


def funding(name: Column, agency: Column, amount: Column, description: Column) -> Column:
    return F.concat_ws(" ", _some(name, "", "."), _some(agency, "Funded by ", "."), _some(amount, "Amount: ", "."), F.nullif(description, F.lit("")))
