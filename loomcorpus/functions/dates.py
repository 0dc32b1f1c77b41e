"""Publication dates from folder names, and the renderings of a date as metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd", "MMM. d, yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MMM d, yyyy")
_MONTHS = ("jan january", "feb february", "mar march", "apr april", "may", "jun june", "jul july", "aug august", "sep sept september", "oct october", "nov november", "dec december")
MONTHS = {name: i + 1 for i, names in enumerate(_MONTHS) for name in names.split()}


def date_meta_values(date: Column) -> Column:
    """Six renderings of a date, sorted, without repeats."""
    return F.array_sort(F.array_distinct(F.array(*[F.date_format(date, f) for f in FORMATS])))


def _core(folder: Column) -> Column:
    return F.translate(F.trim(F.substring_index(folder, "--", 1)), "_", "-")


def folder_date(year: Column, folder: Column) -> Column:
    """The date of a folder MM-DD-YYYY, YYYY-MM-DD or MM-DD (of ``year``), _ for -, what follows --
    ignored; null for other names."""
    core = _core(folder)
    us = F.when(core.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.regexp_replace(core, r"^(\d+)-(\d+)-(\d+)$", "$3-$1-$2"))
    iso = F.when(core.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), core)
    short = F.when(core.rlike(r"^\d{1,2}-\d{1,2}(-|$)"), F.concat_ws("-", year.cast("int"), F.regexp_extract(core, r"^(\d+)-(\d+)", 1), F.regexp_extract(core, r"^(\d+)-(\d+)", 2)))
    return F.coalesce(*[F.try_to_date(x, "yyyy-M-d") for x in (us, iso, short)])


def month_range_date(year: Column, folder: Column) -> Column:
    """Day 1 of the last month that the name holds (``Dec 2025 + Jan 2026``) in ``year``."""
    words = F.split(F.lower(folder), "[^a-z0-9]+", -1)
    months = F.filter(F.transform(words, lambda w: F.element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), w)), lambda m: m.isNotNull())
    last = F.when(F.size(months) > 0, F.element_at(months, -1))
    return F.when(last.isNotNull(), F.make_date(year.cast("int"), last, F.lit(1)))
