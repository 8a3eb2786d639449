"""Names, paths, hashes and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), " ", "_")


def title_from_slug(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))


def taxon_label(c: Column) -> Column:
    return F.initcap(c)


def content_hash(c: Column, digits: int = 64) -> Column:
    """SHA-256 in hex, cut to its first ``digits`` characters."""
    return F.substring(F.sha2(c, 256), 1, digits)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def recording_id(path: Column) -> Column:
    """The first run of three or more digits in the file name, or an empty string."""
    return F.regexp_extract(file_name(path), r"(\d{3,})", 1)


def to_ts(c: Column) -> Column:
    """ISO-8601 text to a UTC timestamp (session time zone UTC)."""
    return F.to_timestamp(c)


def to_iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
