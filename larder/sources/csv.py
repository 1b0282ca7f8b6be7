"""CSV files with the conventions the published data uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.scalars import plain_number
from larder.sources.inference import inferred, repaired_names

# Stands for "no null text": a control character that the data does not contain.
NO_TOKEN = "\u0001"


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, na: str = "NA",
    multiline: bool = False,
) -> DataFrame:
    """Scan a headered CSV; ``na`` is the text that means missing.

    Columns go by name, whatever their order: the header's names are made valid
    (``repaired_names``: "Country Name" is ``Country.Name``, "2000" is ``X2000``) and those of
    ``schema`` are taken; one that is not there is an error, and so is a file whose header differs
    from the others'. Without a schema all columns are, with inferred types (``inferred``).

    An empty text field is the empty string unless ``na`` is empty; in other columns it is missing,
    as is anything that does not parse. ``multiline`` allows line breaks inside quotes but makes each
    file one task.
    """
    reader = spark.read.options(
        nullValue=NO_TOKEN, escape='"', multiLine=multiline, header=False)
    header = [name or "" for name in reader.csv(path).first() or []]
    names = repaired_names(header)
    unique = len({name.lower() for name in header}) == len(header) and "" not in header
    text = T.StructType([
        T.StructField(own if unique else name, T.StringType())
        for own, name in zip(header, names)])
    raw = reader.schema(text).options(header=True, enforceSchema=not unique).csv(path)
    raw = raw.toDF(*names)
    fields = (T.StructType.fromDDL(schema) if schema else inferred(raw, na)).fields
    absent = [f.name for f in fields if f.name not in names]
    if absent:
        raise ValueError(f"the header has no {', '.join(absent)}")
    return raw.select(*(_typed(f, na).alias(f.name) for f in fields))


def _typed(field: T.StructField, na: str) -> Column:
    raw = F.coalesce(F.col(f"`{field.name}`"), F.lit(""))
    known = F.when(raw != na, raw)
    if isinstance(field.dataType, T.StringType):
        return known
    return F.trim(known).try_cast(field.dataType)


def write_csv(df: DataFrame, path: str, na: str = "NA") -> None:
    """Write a headered CSV: ``na`` for missing, numbers without an exponent."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        plain = plain_number(column) if kind in ("double", "float") else column
        columns.append(plain.alias(name))
    (
        df.select(*columns)
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", na)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
