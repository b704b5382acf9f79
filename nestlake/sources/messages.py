"""Protocol-buffer records: message files, and a table layout from their descriptors.

``projected_schema`` turns a message type into a nested Spark schema (enumerations as
text with their members in the metadata, presence as null, empty lists as null), and
``project`` turns a message into a row of it. Recursive types are refused.
"""

from __future__ import annotations

import gzip
import os
from typing import Any

from pyspark.sql import types as T

from ..schema import ENUM

BINARY, TEXT, JSON = ("pb", "binpb"), ("pbtxt", "txtpb"), ("json",)


def _format(path: str) -> tuple[str, bool]:
    parts = os.path.basename(path).split(".")
    zipped = parts[-1] == "gz"
    suffix = parts[-2 if zipped else -1] if len(parts) > 1 + zipped else ""
    if suffix == "parquet":
        raise ValueError("a Parquet file holds a dataset, not a message")
    if suffix not in (*BINARY, *TEXT, *JSON):
        raise ValueError(f"unknown message format: {path!r}")
    return suffix, zipped


def load_message(path: str, kind: type) -> Any:
    suffix, zipped = _format(path)
    with (gzip.open if zipped else open)(path, "rb") as f:
        return parse(f.read(), suffix, kind)


def parse(data: bytes, suffix: str, kind: type) -> Any:
    from google.protobuf import json_format, text_format

    if suffix in BINARY:
        return kind.FromString(data)
    if suffix in TEXT:
        return text_format.Parse(data.decode(), kind())
    return json_format.Parse(data.decode(), kind())


def save_message(message: Any, path: str) -> None:
    """Atomic; a compressed file's bytes depend on the message alone."""
    from google.protobuf import json_format, text_format

    from .dataset import atomic

    suffix, zipped = _format(path)
    if suffix in BINARY:
        data = message.SerializeToString(deterministic=True)
    elif suffix in TEXT:
        data = text_format.MessageToString(message).encode()
    else:
        data = json_format.MessageToJson(message).encode()
    with atomic(path) as temporary, open(temporary, "wb") as f:
        f.write(gzip.compress(data, mtime=0) if zipped else data)


def _scalar(field) -> T.DataType:
    return {
        field.TYPE_DOUBLE: T.DoubleType(), field.TYPE_FLOAT: T.FloatType(), field.TYPE_INT32: T.IntegerType(), field.TYPE_SINT32: T.IntegerType(),
        field.TYPE_SFIXED32: T.IntegerType(), field.TYPE_INT64: T.LongType(), field.TYPE_SINT64: T.LongType(), field.TYPE_SFIXED64: T.LongType(),
        field.TYPE_UINT32: T.LongType(), field.TYPE_FIXED32: T.LongType(), field.TYPE_UINT64: T.DecimalType(20, 0), field.TYPE_FIXED64: T.DecimalType(20, 0),
        field.TYPE_BOOL: T.BooleanType(), field.TYPE_STRING: T.StringType(), field.TYPE_BYTES: T.BinaryType(), field.TYPE_ENUM: T.StringType(),
    }[field.type]


def _is_map(field) -> bool:
    return field.message_type is not None and field.message_type.GetOptions().map_entry


def _many(field) -> bool:
    return field.is_repeated if hasattr(field, "is_repeated") else field.label == field.LABEL_REPEATED


def projected_schema(descriptor, inside: tuple[str, ...] = ()) -> T.StructType:
    if descriptor.full_name in inside:
        raise ValueError(f"{descriptor.full_name} contains itself")
    inside = (*inside, descriptor.full_name)
    fields = []
    for f in descriptor.fields:
        meta = {ENUM: [v.name for v in f.enum_type.values]} if f.enum_type is not None else {}
        one = lambda d: projected_schema(d.message_type, inside) if d.message_type is not None else _scalar(d)
        if _is_map(f):
            key, value = (f.message_type.fields_by_name[n] for n in ("key", "value"))
            kind: T.DataType = T.MapType(_scalar(key), one(value))
        else:
            kind = T.ArrayType(one(f)) if _many(f) else one(f)
        fields.append(T.StructField(f.name, kind, True, meta))
    return T.StructType(fields)


def project(message: Any) -> dict:
    """A row for ``projected_schema``: what is not set is null, lists and maps that are empty too."""
    out: dict[str, Any] = {}
    for f in message.DESCRIPTOR.fields:
        value = getattr(message, f.name)
        one = lambda v, d=f: project(v) if d.message_type is not None else d.enum_type.values_by_number[v].name if d.enum_type is not None else v
        if _is_map(f):
            inner = f.message_type.fields_by_name["value"]
            out[f.name] = [(k, one(v, inner)) for k, v in value.items()] or None
        elif _many(f):
            out[f.name] = [one(v) for v in value] or None
        elif f.has_presence:
            out[f.name] = one(value) if message.HasField(f.name) else None
        else:
            out[f.name] = one(value) if value != f.default_value else None
    return out
