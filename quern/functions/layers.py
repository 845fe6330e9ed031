"""One text of layered SQL expressions for Spark and DuckDB: each layer may use the columns of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the two dialects spell differently.
DIALECT = {"spark": {"BYTES": "octet_length", "RX": "rlike", "DIV": "div"}, "duck": {"BYTES": "strlen", "RX": "~", "DIV": "//"}}


def fill(expr: str, dialect: str) -> str:
    for k, v in DIALECT[dialect].items():
        expr = expr.replace("{" + k + "}", v)
    return expr


def apply(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    """The results pass a generator of one row, so that no filter above is pushed into the layers, where each name would be written out again and again."""
    base, new = df.columns, list(dict.fromkeys(n for x in layers for n in x))
    for layer in layers:
        df = df.selectExpr(*(f"`{c}`" for c in df.columns if c not in layer), *(f"{fill(e, 'spark')} AS {n}" for n, e in layer.items()))
    return df.select(*(c for c in base if c not in new), F.explode(F.array(F.struct(*new))).alias("_r")).select(*(c for c in base if c not in new), "_r.*")


def sql(source: str, layers: list[dict[str, str]]) -> str:
    """A DuckDB subquery in parentheses over source, a table name or subquery."""
    for i, layer in enumerate(layers):
        source = f"(SELECT *, {', '.join(f'{fill(e, 'duck')} AS {n}' for n, e in layer.items())} FROM {source} AS y{i})"
    return source
