"""Column expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from kerbsight.functions import fixed

# What a JSON array, and what any other JSON value, can start with.
_ARRAY_START = r"^\s*\["
_SCALAR_START = r'^\s*["{tfn0-9-]'
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# A time of day followed by an offset, Z, UTC, GMT or a region; and one followed by anything else.
_TIME = r"\d:\d\d(:\d\d(\.\d+)?)?"
_ZONED_TEXT = _TIME + r"\s*(Z|z|UTC|GMT|(UTC|GMT)?[+-]\d\d?(:?\d\d)?|[A-Za-z_]+(/[A-Za-z0-9_+-]+)+)\s*$"
_OTHER_SUFFIX = _TIME + r"\s*[^\s\d:.].*$"


def _whole_json(text: Column) -> Column:
    """The text as a variant; null unless all of it is one JSON value.

    The parser stops at the end of the first value. Inside brackets, and inside braces, what follows
    the value must be their end; no other text fits both.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    values = F.try_variant_get(inside, "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(values) == 1) & member.isNotNull(), F.get(values, 0))


def violation_list(text: Column) -> Column:
    """JSON array → array; JSON scalar → one-element array; other text → itself; null → [].

    The first character decides which parser can succeed. A parser that fails throws an exception
    per row inside the JVM, several times the cost of parsing.
    """
    value = _whole_json(text)
    scalar = F.try_variant_get(value, "$", "string")
    return (
        F.when(text.isNull(), F.array().cast("array<string>"))
        .when(
            text.rlike(_ARRAY_START),
            F.when(
                value.isNotNull(), F.coalesce(F.from_json(text, "array<string>"), F.array(text))
            ).otherwise(F.array(text)),
        )
        .when(text.rlike(_SCALAR_START), F.array(F.coalesce(scalar, text)))
        .otherwise(F.array(text))
    )


def _code(value: Column) -> Column:
    """A JSON integer, or one in quotes, as bigint; null for anything else."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(text.rlike(r"^\s*-?\d+\s*$"), F.trim(text).try_cast("bigint"))


def offence_list(text: Column) -> Column:
    """JSON array → its codes; JSON scalar → one code; text that isn't JSON → [].

    An element that is no integer is null and keeps its place.
    """
    none = F.array().cast("array<bigint>")
    value = _whole_json(text)
    elements = F.try_variant_get(value, "$", "array<variant>")
    return (
        F.when(text.rlike(_ARRAY_START), F.coalesce(F.transform(elements, _code), none))
        .when(text.rlike(_SCALAR_START) & value.isNotNull(), F.array(_code(value)))
        .otherwise(none)
    )


def first_or_unknown(values: Column) -> Column:
    return F.when(F.size(values) == 0, fixed.UNKNOWN).otherwise(F.get(values, 0))


def utc_wall_clock(value: Column, dtype: str) -> Column:
    """UTC time as `timestamp_ntz`, whatever the session time zone; bad text → null.

    Text without a zone is taken as UTC. Offsets, Z, UTC, GMT and region names are converted; other
    zones (abbreviations mean different things in different places) make the text bad.
    """
    if dtype == "timestamp_ntz":
        return value
    if dtype == "string":
        return (
            F.when(value.rlike(_ZONED_TEXT), _instant_to_utc(value.try_cast("timestamp")))
            .when(value.rlike(_OTHER_SUFFIX), F.lit(None).cast("timestamp_ntz"))
            .otherwise(value.try_cast("timestamp_ntz"))
        )
    return _instant_to_utc(value.try_cast("timestamp"))


def _instant_to_utc(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def utc_instant(wall_clock: Column) -> Column:
    """Inverse of `utc_wall_clock`: `timestamp` with the given UTC time, for watermarks."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), wall_clock))


def local_time(wall_clock: Column, zone: str = fixed.LOCAL_TIME_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), wall_clock)


def severity_weight(violation: Column, weights: dict[str, str] | None = None) -> Column:
    """Weight as decimal(4,2): sums are exact, so they do not depend on row order."""
    weights = fixed.SEVERITY_WEIGHTS if weights is None else weights
    decimal = lambda text: F.lit(text).cast("decimal(4,2)")
    table = F.create_map(*[c for name, w in weights.items() for c in (F.lit(name), decimal(w))])
    return F.coalesce(F.try_element_at(table, violation), decimal(fixed.DEFAULT_SEVERITY))


def clip01(value: Column) -> Column:
    """`greatest` and `least` skip nulls, hence the guard."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def unit_range(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; 0.5 where the column is constant."""
    return F.when(high - low > 0, (value - low) / (high - low)).otherwise(F.lit(0.5))


def round_printf(value: Column, digits: int) -> Column:
    """Round the way `printf` and `%.nf` do: by the exact binary value, halves to even.

    Spark's `round`, `bround` and `format_string` work on the shortest decimal text instead, and
    so give 0.73 for the double 0.725, which is a little less than that. The product with 10^n is
    split into the rounded product and its exact error (Dekker); the error decides
    when the product looks like a half. For values up to about 1e9.
    """
    scale = float(10**digits)
    product = value * scale
    stretched = value * 134217729.0  # 2^27 + 1: leaves 26 bits in the upper part
    upper = stretched - (stretched - value)
    error = (upper * scale - product) + (value - upper) * scale
    below = F.floor(product)
    part = product - below
    odd = F.pmod(below, F.lit(2)) == 1
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return (below + F.when(up, 1).otherwise(0)) / scale


def ladder(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """First text whose lower limit the value reaches; the last text otherwise."""
    expr = None
    for limit, text in steps[:-1]:
        step = value >= limit, F.lit(text)
        expr = F.when(*step) if expr is None else expr.when(*step)
    return expr.otherwise(F.lit(steps[-1][1]))


def tier(score: Column) -> Column:
    return ladder(score, [(limit, name) for limit, name, _ in fixed.TIERS])


def action(score: Column) -> Column:
    return ladder(score, [(limit, text) for limit, _, text in fixed.TIERS])


def inside_box(lat: Column, lng: Column) -> Column:
    """Both coordinates within the bounds; null counts as outside."""
    return F.coalesce(
        lat.between(fixed.LAT_MIN, fixed.LAT_MAX) & lng.between(fixed.LNG_MIN, fixed.LNG_MAX),
        F.lit(False),
    )
