"""Results as JSON lines and as aligned text tables, in tasks: for reports and for what command lines print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows (json): each row as an object with its columns in order, nulls written out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def table_rows(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows (line): the columns of widths as text, each cut or filled to its width and two spaces between; what is cut ends
    in `...`, numbers stand right, null is empty, and white space is one space."""
    cells = []
    for name, width in widths.items():
        text = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"\s+", " ")
        text = F.when(F.length(text) > width, F.concat(F.left(text, F.lit(max(0, width - 3))), F.lit("..."[:width]))).otherwise(text)
        right = rows.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or rows.schema[name].dataType.typeName().startswith("decimal")
        cells.append(F.lpad(text, width, " ") if right else F.rpad(text, width, " "))
    return rows.select(F.rtrim(F.concat_ws("  ", *cells)).alias("line"))
