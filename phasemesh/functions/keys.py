"""Session names and other strings of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Form of a session's folder name (fixed value of the data): group, subject, date, time, visit.  Subjects have five digits;
#: numbers over 99999 have more (see :func:`padded`).
SESSION_NAME = r"^ESO_[CP]\d{5,}_\d{8}_\d{4}_\d$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def session_fields(name) -> dict[str, Column]:
    """Fields of a session's folder name: group letter, subject and visit by position; null if it has another form."""
    name = _c(name)
    good = name.rlike(SESSION_NAME)
    return {
        "grp": F.when(good, F.lower(F.substring(name, 5, 1))),
        "subject_id": F.when(good, F.split(name, "_")[1]),
        "visit": F.when(good, F.substring(name, -1, 1).cast("int")),
    }


def padded(x, width: int = 5) -> Column:
    """Zero-padded; longer numbers are left whole."""
    return F.format_string(f"%0{width}d", _c(x).cast("long"))


def words(x) -> Column:
    """Split at runs of white space, commas removed."""
    return F.split(F.trim(F.translate(_c(x), ",", "")), r"\s+")


def first_match(items: Column, wanted: list[str]) -> Column:
    """The first of ``items`` that contains any wanted text, ignoring case; null if none does."""
    wanted_col = F.array(*[F.lit(w.lower()) for w in wanted])
    return F.get(F.filter(items, lambda s: F.exists(wanted_col, lambda v: F.contains(F.lower(s), v))), F.lit(0))


def display_list(x: Column) -> Column:
    """``(a, b, c)`` of an array's sorted items."""
    return F.concat(F.lit("("), F.array_join(F.sort_array(x), ", "), F.lit(")"))


def stem(x) -> Column:
    return F.split(_c(x), r"\.")[0]


def date_suffix() -> Column:
    return F.replace(F.current_date().cast("string"), F.lit("-"), F.lit(""))
