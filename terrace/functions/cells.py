"""Column expressions for table cells: cleaning, parsing, kinds, display."""

from __future__ import annotations

import math
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrace.functions.text import strip

_INT = r"^[+-]?\d+(_\d+)*$"
_FLOAT = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
_WORDS = r"(?i)^[+-]?(inf|infinity|nan)$"
#: Digits that an integer has at most; a number of more is a float.
MOST_DIGITS = 4300
_STAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?)?$"


def clean_cell(raw: Column) -> Column:
    """Stripped, empty as null."""
    return F.nullif(strip(raw), F.lit(""))


@F.pandas_udf(StringType())
def format6(x: pd.Series) -> pd.Series:
    """Six significant digits, rounded on the exact binary value (the JVM's
    formatter rounds the shortest decimal, which differs on ties)."""
    return pd.Series([None if pd.isna(v) else "%.6g" % v for v in x], dtype=object)


def number_cell(x: Column) -> Column:
    """A double as (kind, shown, number): integral ones are integers; what a
    float shows is left null, for ``shown`` to fill in on distinct values."""
    whole = (x == F.floor(x)) & (F.abs(x) < 2.0**53)
    return F.struct(
        F.when(whole, "integer").otherwise("float").alias("kind"),
        F.when(whole, x.cast("decimal(20,0)").cast("string")).alias("shown"),
        x.alias("number"),
    )


def shown(cell: Column) -> Column:
    """What a cell shows."""
    return F.coalesce(cell["shown"], format6(cell["number"]))


def _stamp(t: Column) -> Column:
    midnight = (F.hour(t) == 0) & (F.minute(t) == 0) & (F.second(t) == 0)
    return F.when(midnight, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def _cell(kind: str, shown: Column, number: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), shown.alias("shown"), (F.lit(None).cast("double") if number is None else number).alias("number"))


def parse_cell(raw: Column) -> Column:
    """struct(kind, shown, number) of a text cell; null for an empty one."""
    v = clean_cell(raw)
    low = F.lower(v)
    bare = F.replace(v, F.lit("_"), F.lit(""))
    sign = F.when(bare.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(bare, "^[+-]", ""), "^0+(?=.)", "")
    integer = F.concat(F.when(digits == "0", "").otherwise(sign), digits)
    loose = F.when(v.contains(",") & v.contains("."), F.replace(v, F.lit(","), F.lit(""))).otherwise(v)
    is_float = loose.rlike(_FLOAT)
    x = F.replace(loose, F.lit("_"), F.lit("")).try_cast("double")
    word = F.regexp_replace(F.lower(v), "^[+]", "")
    iso = F.regexp_replace(v, "/", "-")
    t = F.try_to_timestamp(F.replace(F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 26), F.lit(","), F.lit("."))).cast("timestamp_ntz")
    return (
        F.when(v.isNull(), F.lit(None))
        .when(low.isin("true", "false"), _cell("boolean", F.initcap(low)))
        .when(v.rlike(_INT) & (F.length(F.regexp_replace(bare, "^[+-]", "")) <= MOST_DIGITS), _cell("integer", integer, bare.try_cast("double")))
        .when(is_float, number_cell(x))
        .when(v.rlike(_WORDS), _cell("float", F.regexp_replace(word, "infinity", "inf"), F.when(word.endswith("nan"), float("nan")).when(word.startswith("-"), float("-inf")).otherwise(float("inf"))))
        .when(F.length(v).between(8, 32) & iso.rlike(_STAMP) & t.isNotNull(), _cell("datetime", _stamp(t)))
        .otherwise(_cell("text", v))
    )


def _parsed(v: str) -> tuple:
    if v.lower() in ("true", "false"):
        return "boolean", v.capitalize(), None
    if re.match(_INT, v):
        try:
            n = int(v)
        except ValueError:  # more digits than an int is read from: a float, beyond its range
            x = float(v)
            return "float", "%.6g" % x, x
        return "integer", str(n), float(n) if len(v) < 300 else math.inf if n > 0 else -math.inf
    loose = v.replace(",", "") if "," in v and "." in v else v
    if re.match(_FLOAT, loose) or re.match(_WORDS, v):
        x = float(loose)
        return ("integer", str(int(x)), x) if x.is_integer() and abs(x) < 2**53 else ("float", "%.6g" % x, x)
    if re.match(r"\d{4}[-/]", v) and 8 <= len(v) <= 32:
        try:
            t = datetime.fromisoformat(v.replace("/", "-"))
        except ValueError:
            return "text", v, None
        return "datetime", t.strftime("%Y-%m-%d %H:%M:%S" if (t.hour, t.minute, t.second) != (0, 0, 0) else "%Y-%m-%d"), None
    return "text", v, None


@F.pandas_udf(StructType([StructField("kind", StringType()), StructField("shown", StringType()), StructField("number", DoubleType())]))
def parse_values(raw: pd.Series) -> pd.DataFrame:
    """``parse_cell`` over Arrow batches, for the distinct values of a table."""
    rows = [_parsed(v) for v in raw]
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate((("kind", object), ("shown", object), ("number", float)))})


def typed_cell(column: Column, kind: str) -> Column:
    """struct(kind, shown, number) of a cell that has its type already (Spark's name of it); null stays null."""
    if kind == "string":
        v = clean_cell(column)
        out = _cell("text", v)
        return F.when(v.isNotNull(), out)
    if kind == "boolean":
        out = _cell("boolean", F.initcap(column.cast("string")))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        out = _cell("integer", column.cast("string"), column.cast("double"))
    elif kind in ("float", "double") or kind.startswith("decimal"):
        x = column.cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x), number_cell(x))
    elif kind in ("timestamp", "timestamp_ntz", "date"):
        out = _cell("datetime", _stamp(column.cast("timestamp_ntz")))
    elif kind.startswith("interval"):
        out = _cell("duration", column.cast("string"))
    else:
        out = _cell("text", column.cast("string") if not kind.startswith(("array", "map", "struct")) else F.to_json(column))
    return F.when(column.isNotNull(), out)
