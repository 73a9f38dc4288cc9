"""Delimited text: a lossless quoted form, and plain lines without quoting."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ends a field nowhere in a text file, so the reader leaves whole lines together.
_NEVER = "\x01"
_MORE = "__more"
_NULL = "\x01null"
_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = "|",
    header: bool = True,
    quoted: bool = False,
    skipped: Observation | None = None,
) -> DataFrame:
    """Read separated text with a declared schema.

    A row with too few fields is padded with nulls, one with too many is left out, and text that
    does not fit its type is null. ``skipped`` counts the rows left out while the result is read,
    without a pass of its own; see ``warn_skipped``.

    Plain lines (the default) know no quotes: every line is a row and an empty field is null. Spark
    splits large files between tasks and skips the header of each one. ``quoted`` reads what
    ``write_delimited`` writes: fields may hold the separator, quotes and line breaks, and a quoted empty
    field is the empty text. There a row is too long when its first field beyond the schema is not null.
    """
    if quoted:
        names = [f"f{i}" for i in range(len(schema.fields))]
        texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _MORE]])
        # The null mark stands for empty fields inside the reader; without it the quoted empty text would be null too.
        reader = spark.read.schema(texts).options(
            sep=sep, header=header, multiLine=True, enforceSchema=True, nullValue=_NULL, emptyValue="", **_QUOTING
        )
        rows, long = reader.csv(path), F.col(_MORE).isNotNull()
        values = [F.col(n) for n in names]
    else:
        reader = spark.read.schema("line string").option("sep", _NEVER).option("quote", "").option("header", header)
        rows = reader.csv(path).select(F.split("line", f"\\Q{sep}\\E", -1).alias("f"))
        long = F.size("f") > len(schema.fields)
        values = [F.nullif(F.get("f", F.lit(i)), F.lit("")) for i in range(len(schema.fields))]
    if skipped is not None:
        rows = rows.observe(skipped, F.count_if(long).alias("rows"))
    kept = rows.where(~long)
    return kept.select(*[v.try_cast(f.dataType).alias(f.name) for v, f in zip(values, schema.fields, strict=True)])


def warn_skipped(skipped: Observation, path: str) -> int:
    """Warn about rows that a finished read of ``path`` left out, and return their number."""
    n = skipped.get["rows"]
    if n:
        warnings.warn(f"{path}: {n} rows with too many fields were left out", stacklevel=2)
    return n


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    """Write separated text with a header.

    Fields that hold the separator, a quote or a line break are quoted, quotes inside are doubled, null is
    an empty field and the empty text a quoted one, so ``read_delimited(quoted=True)`` gives the same rows.
    """
    (
        df.write.mode("overwrite")
        .options(sep=sep, header=True, emptyValue='""', nullValue="", **_QUOTING)
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        .csv(path)
    )
