"""Reading lead tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.config import LEAD_COLUMNS

# Free text holds line breaks and quotes, which the CSV defaults break on; the writer would also
# trim blanks and line breaks off the ends of cells.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}
CSV_WRITE_OPTIONS = {
    "header": True,
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


class EmptyLeads(ValueError):
    """The lead table could not be read or has no rows."""


def read_leads(
    spark: SparkSession,
    source: str,
    format: str = "parquet",
    schema: StructType | str | None = None,
    **options,
) -> DataFrame:
    """Lead table from files (``parquet``, ``csv``, ``json``, ``orc``) or a catalog table (``table``).

    The four lead columns are strings, whatever the source says, so that ``1`` never turns into
    ``1.0``; other columns pass through. A CSV file is read by its header with every column as
    string: no pass over the data to infer types. Every call plans a new scan.
    """
    if format == "table":
        leads = spark.table(source)
    else:
        reader = spark.read.options(**(CSV_OPTIONS if format == "csv" else {})).options(**options)
        if schema is not None:
            reader = reader.schema(schema)
        leads = reader.format(format).load(source)
    return as_leads(leads)


def as_leads(table: DataFrame) -> DataFrame:
    """Lead columns that are present cast to string, all others untouched."""
    names = [c for c in LEAD_COLUMNS if c in table.columns]
    return table.withColumns({c: F.col(c).cast("string") for c in names})


def require_rows(leads: DataFrame | None) -> DataFrame:
    """The table itself, or ``EmptyLeads``. Reads one row at most."""
    if leads is None or leads.isEmpty():
        raise EmptyLeads("the lead table is missing or has no rows")
    return leads


def row_count(leads: DataFrame) -> int:
    return leads.count()
