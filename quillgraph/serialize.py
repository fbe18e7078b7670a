"""Results as JSON: field names as they are, NULLs kept, times in ISO form with their offset."""

from __future__ import annotations

import dataclasses
import json
from datetime import datetime, timezone
from enum import Enum
from pathlib import Path
from typing import Any, TextIO
from uuid import UUID

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aware(value: datetime) -> datetime:
    """A time with its offset; one without says nothing about when it is, so it is refused."""
    if value.tzinfo is None or value.utcoffset() is None:
        raise ValueError(f"a time without an offset: {value.isoformat()}")
    return value


def to_json_value(value: Any) -> Any:
    """Plain JSON types for rows, dataclasses, enums, ids, paths, times and collections."""
    if isinstance(value, Enum):
        return value.value
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    if isinstance(value, (UUID, Path)):
        return str(value)
    if isinstance(value, datetime):
        return aware(value).astimezone(timezone.utc).isoformat()
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: to_json_value(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, Row):
        # Spark gives times of the session's zone, UTC, without it.
        own = lambda v: v.replace(tzinfo=timezone.utc) if isinstance(v, datetime) and v.tzinfo is None else v
        return {k: to_json_value(own(v)) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {to_json_value(k): to_json_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [to_json_value(v) for v in value]
    raise TypeError(f"no JSON form for {type(value).__name__}")


def success(data: Any, warnings: list[str] = ()) -> dict:
    return {"ok": True, "data": to_json_value(data), "warnings": list(warnings)}


def failure(error: Exception) -> dict:
    return {"ok": False, "error": {"type": type(error).__name__, "message": str(error)}}


def write_success(out: TextIO, data: Any, warnings: list[str] = ()) -> None:
    """``success`` as text, where ``data`` may be, or hold as a dict's values, DataFrames: these are
    written row by row as they come, a partition at a time, and never held as a whole."""

    def write(value: Any, depth: int) -> None:
        if isinstance(value, DataFrame):
            between = "["
            for row in json_lines(value).toLocalIterator():
                out.write(f"{between}\n{'  ' * (depth + 1)}{row.json}")
                between = ","
            out.write("[]" if between == "[" else "\n" + "  " * depth + "]")
        elif isinstance(value, dict) and any(isinstance(v, DataFrame) for v in value.values()):
            out.write("{")
            for k, (name, each) in enumerate(value.items()):
                out.write(("," if k else "") + "\n" + "  " * (depth + 1) + json.dumps(name, ensure_ascii=False) + ": ")
                write(each, depth + 1)
            out.write("\n" + "  " * depth + "}")
        else:
            text = json.dumps(to_json_value(value), ensure_ascii=False, indent=2)
            out.write(text.replace("\n", "\n" + "  " * depth))

    out.write('{\n  "ok": true,\n  "data": ')
    write(data, 1)
    out.write(',\n  "warnings": ' + json.dumps(list(warnings), ensure_ascii=False) + "\n}\n")


def dumps(envelope: dict) -> str:
    return json.dumps(envelope, ensure_ascii=False, indent=2)


def _iso(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(column, "SSSSSS")
        return F.concat(
            whole,
            F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""),
            F.lit("+00:00"),
        )
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_iso(column[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), inner)
    return column


def json_lines(df: DataFrame) -> DataFrame:
    """(json): every row as one JSON object, made by the executors. The session's time zone is UTC."""
    columns = [_iso(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
