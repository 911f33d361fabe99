"""Text-to-type parsing expressions used by the cleaning step. A value that does not parse is NULL, so
that the row can be set aside with a reason (or stop the job, in strict mode)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType

from ..sources.schema import UNKNOWN

#: A whole calendar date, year first, with or without a time of day after it. Spark's own cast would also take a year or a
#: month alone and invent the rest.
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"


def blank_to_null(c: Column) -> Column:
    """TRIM (spaces only) then '' -> NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def text_or_unknown(c: Column) -> Column:
    """Normalise a label column: trimmed text, blank or NULL becomes ``UNKNOWN``."""
    return F.coalesce(blank_to_null(c), F.lit(UNKNOWN))


def parse_date(c: Column, date_format: str | None = None) -> Column:
    """A date written as ``ISO_DATE``, or by ``date_format`` (a Spark pattern such as ``dd.MM.yyyy``)."""
    text = blank_to_null(c)
    if date_format is not None:
        return F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    return F.when(text.rlike(ISO_DATE), F.split_part(F.translate(text, "T", " "), F.lit(" "), F.lit(1)).try_cast("date"))


def parse_decimal(c: Column, to: DataType) -> Column:
    """Numbers written with thousands separators: strip ',' then cast (the cast rounds HALF_UP
    to the target scale)."""
    return F.nullif(F.replace(F.trim(c), F.lit(","), F.lit("")), F.lit("")).try_cast(to)


def parse_int(c: Column) -> Column:
    return blank_to_null(c).try_cast("int")
