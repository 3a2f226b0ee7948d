"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..functions.columns import col, cols, require
from ..operators.blocks import row_index
from ..operators.timeseries import TOD


def write_csv_table(
    df: DataFrame,
    path: str,
    row_numbers: Sequence[str] | None = None,
    null: str = "NA",
    sep: str = ",",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """CSV with header; ``row_numbers`` names the order to number rows in.

    Stamps are written with as many decimals as they have.
    """
    stamps = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType | T.TimestampType)}
    out = df
    if row_numbers is not None:
        numbered = row_index(df, [], row_numbers, "row")
        out = numbered.select("row", *cols(df.columns))
    out = out.select(*[col(c).cast("string").alias(c) if c in stamps else col(c) for c in out.columns])
    writer = out.write.mode(mode).options(header=True, nullValue=null, sep=sep)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_logger(
    df: DataFrame,
    path: str,
    ts: str = "TIMESTAMP",
    tods: Sequence[str] = TOD,
    mode: str = "errorifexists",
) -> None:
    """Data part of a logger export: all quoted, NULL empty, times un-padded."""
    require(df, [ts, *tods])
    out = df.select(
        *[
            F.date_format(col(c), "yyyy-MM-dd HH:mm:ss").alias(c)
            if c == ts
            else clock.unpad_hm(c).alias(c)
            if c in tods
            else col(c)
            for c in df.columns
        ]
    )
    out.write.mode(mode).options(header=False, quoteAll=True, nullValue="", emptyValue="").csv(path)
