"""Column expressions that the parsers share, and tables of literals."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def parent(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def number(x: Column) -> Column:
    """A double where the text is a plain decimal number, inf or nan; else NULL."""
    plain = strip(x).rlike("(?i)^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$")
    return F.when(plain, strip(x).try_cast("double"))


def computed(df: DataFrame) -> DataFrame:
    """The same rows, computed once at this point: later filters and uses don't repeat the expressions of the columns."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def literal_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small fixed table as SQL values, which need no Python side; columns: name → type."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    kinds = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns.items())
    return spark.sql(f"SELECT {kinds} FROM VALUES {values} AS t({', '.join(columns)})")
