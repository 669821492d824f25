"""Searches and lists: optional filters, text search over several columns, pages with their envelope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a record search reads; parameters of the record list, and how each is compared.
SEARCHED = ("owner_name", "survey_number", "khasra_number", "khata_number", "village", "district")
PARAMETERS = {"status": ("status", "is"), "state": ("state", "same"), "district": ("district", "same"), "village": ("village", "holds"), "survey_number": ("survey_number", "same"), "owner": ("owner_name", "holds")}


def any_holds(columns: list[str], text: str) -> Column:
    """Whether any of the columns holds the text, in any case; all do where there is no text."""
    if not text.strip():
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.strip().lower()) for c in columns])


def chosen(df: DataFrame, parameters: dict[str, str], search: str = "") -> DataFrame:
    """Rows that all given parameters fit; a parameter that is blank or unknown filters nothing."""
    tests = {"is": lambda c, v: c == v, "same": lambda c, v: F.lower(c) == v.lower(), "holds": lambda c, v: F.lower(c).contains(v.lower())}
    for name, value in parameters.items():
        if value and name in PARAMETERS and PARAMETERS[name][0] in df.columns:
            column, how = PARAMETERS[name]
            df = df.where(tests[how](F.col(column), value.strip()))
    if parameters.get("duplicates") == "1" and "is_duplicate" in df.columns:
        df = df.where("is_duplicate")
    return df.where(any_holds([c for c in SEARCHED if c in df.columns], search)) if search.strip() else df


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """A page of an ordered list with its envelope: each row with count, page and pages. A number outside of the list gives the
    nearest page; an empty list has one empty page. The order must end in a unique column."""
    count = df.count()
    pages = max(1, -(-count // size))
    number = min(max(number, 1), pages)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumns({"count": F.lit(count).cast("long"), "page": F.lit(number).cast("long"), "pages": F.lit(pages).cast("long")})


def status_class(x: Column) -> Column:
    return F.when(x.isin("PROCESSED", "VERIFIED"), "ok").when(x == "PENDING", "warn").when(x.isin("FAILED", "REJECTED"), "bad").otherwise("info")
