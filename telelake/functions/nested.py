"""Translation of nested OTLP/JSON values, the one piece of Python that runs in tasks.

The module is pickled by value, so executors need not have the package installed.
"""

from __future__ import annotations

import base64
import json
import math
import sys

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole(value) -> int:
    number = int(value)
    if not -(1 << 63) <= number < 1 << 63:
        raise ValueError(number)
    return number


def plain(value) -> list:
    """``[json-ready value]``, or ``[]`` for a value that holds nothing."""
    if not isinstance(value, dict):
        return []
    held = {name: item for name, item in value.items() if item is not None}
    if "stringValue" in held:
        return [held["stringValue"]]
    if "intValue" in held:
        return [whole(held["intValue"])]
    if "doubleValue" in held:
        real = float(held["doubleValue"])
        return [real if math.isfinite(real) else None]
    if "boolValue" in held:
        return [held["boolValue"]]
    if "bytesValue" in held:
        return [base64.b64decode(held["bytesValue"], validate=True).hex()]
    if "arrayValue" in held:
        return [[p for item in held["arrayValue"].get("values") or [] for p in plain(item)]]
    if "kvlistValue" in held:
        pairs = held["kvlistValue"].get("values") or []
        return [{pair.get("key") or "": p for pair in pairs for p in plain(pair.get("value"))}]
    return []


def translate(text: str) -> str | None:
    """Plain JSON text of a nested OTLP/JSON value, keys sorted; None if it cannot be read."""
    try:
        [value] = plain(json.loads(text))
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


def all_readable(texts: pa.Array) -> pa.Array:
    """Per row whether every given text can be translated; no texts can."""
    return pa.array(
        [row is None or all(translate(text) is not None for text in row) for row in texts.to_pylist()],
        type=pa.bool_(),
    )


def translate_all(texts: pa.Array) -> pa.Array:
    """Per row a map from each given text to its translation."""
    kind = pa.map_(pa.string(), pa.string())
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    translated = [
        None if row is None else [(text, translate(text)) for text in row]
        for row in texts.to_pylist()
    ]
    return pa.array(translated, type=kind)
