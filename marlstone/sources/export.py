"""Answers as CSV and JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def csv_cell(value: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One text row per row; nested values as JSON.  The header is ``csv_header``."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, ArrayType | MapType | StructType)}
    cells = [csv_cell(F.to_json(c) if c in nested else F.col(c)) for c in (names or df.columns)]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def csv_header(names: dict[str, str] | list[str]) -> str:
    return ",".join(names.values() if isinstance(names, dict) else names)


def csv_text(df: DataFrame, names: dict[str, str] | None = None) -> str:
    """For answers of limited size; no rows give no header."""
    lines = [r["line"] for r in csv_lines(df, names).collect()]
    return "\n".join([csv_header(names or df.columns), *lines]) if lines else ""


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def json_text(answer: Mapping) -> str:
    """A whole answer, tables as lists of objects, keys in camel case."""
    def plain(value):
        if isinstance(value, DataFrame):
            return [plain(r.asDict(True)) for r in value.collect()]
        if isinstance(value, Mapping):
            return {camel(k): plain(v) for k, v in value.items()}
        return [plain(v) for v in value] if isinstance(value, list) else value

    return json.dumps(plain(answer), ensure_ascii=False, indent=2, default=str)
