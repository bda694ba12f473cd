"""Spanish calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month names and short labels.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
SHORT = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def parse_long_date(c: Column) -> Column:
    """``jueves 27 agosto 2026 04:00 pm`` to a date; anything else to null."""
    pattern = r"(\d{1,2})\s+([a-záéíóúñ]+)\s+(\d{4})"
    low = F.lower(c)
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    month = F.try_element_at(number, F.regexp_extract(low, pattern, 2))
    text = F.concat_ws("-", F.regexp_extract(low, pattern, 3), month.cast("string"), F.regexp_extract(low, pattern, 1))
    return F.when(low.rlike(pattern) & month.isNotNull(), F.try_to_date(text, "y-M-d"))


def month_label(month: Column) -> Column:
    """``Ene 2026``."""
    return F.concat_ws(
        " ",
        F.element_at(F.array(*[F.lit(s) for s in SHORT]), F.month(month)),
        F.year(month).cast("string"),
    )


def next_months(last: Column, h: int) -> Column:
    """The ``h`` months after ``last`` as an array of dates."""
    return F.sequence(F.add_months(last, 1), F.add_months(last, h), F.expr("interval 1 month"))
