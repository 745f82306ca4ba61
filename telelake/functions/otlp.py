"""Functions on OpenTelemetry values as they appear in OTLP/JSON.

Scalars are handled by native expressions. Arrays and key/value lists nest without
limit, which SQL expressions cannot follow; their JSON text is translated by one
Arrow UDF that sees NULL for every row without such values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telelake.functions.nested import all_readable, translate_all
from telelake.functions.scalars import empty_to_null, hex_lower, plain_double

ANY_VALUE = (
    "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,"
    "bytesValue:string,arrayValue:string,kvlistValue:string>"
)
KEY_VALUES = f"array<struct<key:string,value:{ANY_VALUE}>>"
SERVICE_KEY = "service.name"
UNKNOWN_SERVICE = "unknown"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and build an expression on it.

    As the start of an aggregation over nothing: a transformation would copy the value and the result, whole events here.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def quoted(text: Column) -> Column:
    """JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def bytes_hex(text: Column) -> Column:
    """Hex of a base64 bytes field."""
    return hex_lower(F.unbase64(text))


def is_present(value: Column) -> Column:
    fields = [
        value.getField(f)
        for f in (
            "stringValue",
            "boolValue",
            "intValue",
            "doubleValue",
            "bytesValue",
            "arrayValue",
            "kvlistValue",
        )
    ]
    return F.coalesce(*[F.when(f.isNotNull(), True) for f in fields], F.lit(False))


def nested_text(value: Column) -> Column:
    """OTLP/JSON text of an array or key/value list, NULL for scalars."""
    return F.coalesce(
        F.concat(F.lit('{"arrayValue":'), value.getField("arrayValue"), F.lit("}")),
        F.concat(F.lit('{"kvlistValue":'), value.getField("kvlistValue"), F.lit("}")),
    )


def is_nested(value: Column) -> Column:
    return value.getField("arrayValue").isNotNull() | value.getField("kvlistValue").isNotNull()


def any_nested(pairs: Column) -> Column:
    """Whether some pair holds an array or key/value list; false for no pairs."""
    return F.coalesce(F.exists(pairs, lambda kv: is_nested(kv.getField("value"))), F.lit(False))


def nested_texts(pairs: Column) -> Column:
    """OTLP/JSON texts of the nested values among the pairs."""
    texts = F.transform(pairs, lambda kv: nested_text(kv.getField("value")))
    return F.coalesce(F.filter(texts, lambda t: t.isNotNull()), F.array().cast("array<string>"))


def scalar_json(value: Column) -> Column:
    number = value.getField("doubleValue")
    finite = ~F.isnan(number) & ~number.isin(float("inf"), float("-inf"))
    return F.coalesce(
        quoted(value.getField("stringValue")),
        value.getField("intValue").try_cast("bigint").cast("string"),
        F.when(number.isNotNull(), F.when(finite, number.cast("string")).otherwise("null")),
        value.getField("boolValue").cast("string"),
        F.concat(F.lit('"'), bytes_hex(value.getField("bytesValue")), F.lit('"')),
    )


def nested_lookup(texts: Column, found: Column) -> Column:
    """Map from nested OTLP/JSON text to plain JSON text, where ``found`` says there is any."""
    translate = F.arrow_udf(translate_all, "map<string,string>")
    return translate(F.when(found, F.array_distinct(texts)))


def _all(items: Column, test) -> Column:
    """Whether every element passes; absent lists and elements do."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(test(x), F.lit(True))), F.lit(True))


def readable_value(value: Column) -> Column:
    """Whether the scalars of a value are what their fields promise."""
    number, data = value.getField("intValue"), value.getField("bytesValue")
    return (number.isNull() | number.try_cast("bigint").isNotNull()) & (
        data.isNull() | F.try_to_binary(data, F.lit("base64")).isNotNull()
    )


def readable_pairs(pairs: Column) -> Column:
    return _all(pairs, lambda kv: readable_value(kv.getField("value")))


def readable_nanos(text: Column) -> Column:
    """Whether a time in nanoseconds fits a signed 64-bit number; absent times count as 0."""
    return text.isNull() | F.coalesce(text.try_cast("bigint") >= 0, F.lit(False))


def readable_logs(request: Column) -> Column:
    """Whether every record of a log request can be loaded, nested values aside."""

    def record(r: Column) -> Column:
        return (
            readable_nanos(r.getField("timeUnixNano"))
            & F.coalesce(readable_value(r.getField("body")), F.lit(True))
            & readable_pairs(r.getField("attributes"))
        )

    return _all(
        request.getField("resourceLogs"),
        lambda r: readable_pairs(r.getField("resource").getField("attributes"))
        & _all(r.getField("scopeLogs"), lambda s: _all(s.getField("logRecords"), record)),
    )


def readable_spans(request: Column) -> Column:
    """Whether every span of a request can be loaded, nested values aside."""

    def event(e: Column) -> Column:
        return readable_nanos(e.getField("timeUnixNano")) & readable_pairs(e.getField("attributes"))

    def span(s: Column) -> Column:
        return (
            readable_nanos(s.getField("startTimeUnixNano"))
            & readable_nanos(s.getField("endTimeUnixNano"))
            & readable_pairs(s.getField("attributes"))
            & _all(s.getField("events"), event)
        )

    return _all(
        request.getField("resourceSpans"),
        lambda r: readable_pairs(r.getField("resource").getField("attributes"))
        & _all(r.getField("scopeSpans"), lambda s: _all(s.getField("spans"), span)),
    )


def _every(items: Column, texts) -> Column:
    """Texts of all elements in one list."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(items, lambda x: F.coalesce(texts(x), none))), none)


def log_texts(request: Column) -> Column:
    """All nested values of a log request."""

    def record(r: Column) -> Column:
        body = F.array_compact(F.array(nested_text(r.getField("body"))))
        return F.concat(nested_texts(r.getField("attributes")), body)

    return _every(
        request.getField("resourceLogs"),
        lambda r: F.concat(
            nested_texts(r.getField("resource").getField("attributes")),
            _every(r.getField("scopeLogs"), lambda s: _every(s.getField("logRecords"), record)),
        ),
    )


def span_texts(request: Column) -> Column:
    """All nested values of a span request that are stored."""

    def span(s: Column) -> Column:
        return F.concat(
            nested_texts(s.getField("attributes")),
            _every(s.getField("events"), lambda e: nested_texts(e.getField("attributes"))),
        )

    return _every(
        request.getField("resourceSpans"),
        lambda r: _every(r.getField("scopeSpans"), lambda s: _every(s.getField("spans"), span)),
    )


def readable_nested(texts: Column) -> Column:
    """Whether all nested values can be read; Python sees NULL where there are none."""
    check = F.arrow_udf(all_readable, "boolean")
    return check(F.when(F.size(texts) > 0, texts))


def no_nested_lookup(found: Column) -> Column:
    """Stand-in for :func:`nested_lookup` that refuses nested values instead of losing them."""
    empty = F.lit(None).cast("map<string,string>")
    refuse = F.raise_error(F.lit("nested attribute value; normalise with nested=True"))
    return F.when(found, refuse.cast("map<string,string>")).otherwise(empty)


def any_value_json(value: Column, lookup: Column | None = None) -> Column:
    """JSON text of a value; NULL when it holds nothing."""
    scalar = scalar_json(value)
    if lookup is None:
        return scalar
    return F.coalesce(scalar, F.element_at(lookup, nested_text(value)))


def key_values_json(pairs: Column, lookup: Column | None = None) -> Column:
    """JSON object text of a key/value list.

    No pairs give NULL; pairs without a value are left out; the last of equal keys
    wins; keys come out sorted.
    """

    def entry(pair: Column, index: Column) -> Column:
        return F.named_struct(
            F.lit("key"),
            F.coalesce(pair.getField("key"), F.lit("")),
            F.lit("index"),
            index,
            F.lit("json"),
            any_value_json(pair.getField("value"), lookup),
        )

    present = F.filter(pairs, lambda kv: is_present(kv.getField("value")))
    ordered = F.array_sort(F.transform(present, entry))

    def render(items: Column) -> Column:
        last = F.filter(
            items,
            lambda item, i: ~F.coalesce(
                F.get(items, i + 1).getField("key") == item.getField("key"), F.lit(False)
            ),
        )
        parts = F.transform(
            last, lambda item: F.concat(quoted(item.getField("key")), F.lit(":"), item.getField("json"))
        )
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    # One pair has nothing to sort; this is most lists, and plain expressions are much cheaper than lambdas.
    only = F.get(pairs, F.lit(0))
    value = only.getField("value")
    part = F.concat(quoted(F.coalesce(only.getField("key"), F.lit(""))), F.lit(":"), any_value_json(value, lookup))
    single = F.concat(F.lit("{"), F.coalesce(F.when(is_present(value), part), F.lit("")), F.lit("}"))
    return F.when(F.size(pairs) == 1, single).when(F.size(pairs) > 1, let(ordered, render))


def service_name(pairs: Column) -> Column:
    """Last string-valued ``service.name``; other types are passed over."""
    names = F.filter(
        pairs,
        lambda kv: (kv.getField("key") == SERVICE_KEY)
        & kv.getField("value").getField("stringValue").isNotNull(),
    )
    last = F.try_element_at(names, F.lit(-1)).getField("value").getField("stringValue")
    return F.coalesce(last, F.lit(UNKNOWN_SERVICE))


def body_text(value: Column, lookup: Column | None = None) -> Column:
    """Log body as text: scalars printed plainly, nested values as JSON."""
    plain = F.coalesce(
        value.getField("stringValue"),
        value.getField("intValue").try_cast("bigint").cast("string"),
        plain_double(value.getField("doubleValue")),
        value.getField("boolValue").cast("string"),
        bytes_hex(value.getField("bytesValue")),
    )
    if lookup is None:
        return plain
    return F.coalesce(plain, F.element_at(lookup, nested_text(value)))


def hex_id(text: Column) -> Column:
    """OTLP/JSON carries ids as hex text already."""
    return F.lower(text)


def optional_hex_id(text: Column) -> Column:
    return empty_to_null(hex_id(text))
