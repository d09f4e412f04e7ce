"""Text expressions: cleaning, number text, content lines. All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

# The Unicode white-space characters.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

UNKNOWN = "?"

# Measure label, column, decimals and unit of a reference's content line.
CONTENT_MEASURES = (
    ("mass", "planet_mass", 2, "Earth masses"),
    ("radius", "planet_radius", 2, "Earth radii"),
    ("period", "orbital_period", 2, "days"),
    ("temp", "equilibrium_temp", 0, "K"),
    ("density", "planet_density", 2, "g/cm3"),
)


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (trim_all(c) == "")


def equals_ignore_case(c: Column, value: str) -> Column:
    """Null-safe, so that a missing name is a plain "no"."""
    return F.lower(c).eqNullSafe(F.lit(value.lower()))


def key_of_name(c: Column) -> Column:
    """Case-insensitive join key."""
    return F.upper(c)


def _number_text(x: Column) -> Column:
    raw = x.cast("string")
    size = F.abs(x)
    zeros, point = F.lit("0"), F.lit(".")
    plain = F.rtrim(F.rtrim(raw.try_cast("decimal(38,21)").cast("string"), zeros), point)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.format_string("E%+03d", F.substring_index(raw, "E", -1).try_cast("int"))
    return (
        F.when((size >= 1e-4) & (size < 1e15), plain)
        .when(x == 0, F.regexp_replace(raw, r"\.0$", ""))
        .when(F.isnan(x) | size.isin(float("inf")), raw)
        .otherwise(F.concat(mantissa, power))
    )


def num_to_text(c: Column) -> Column:
    """Shortest text of a double: ``5``, ``5.25``, ``0.0001``, ``1E-05``, ``1E+16``.

    Inside a ``transform``, so that a change row's many texts do not make a generated method
    too long for the JIT.
    """
    return F.transform(F.array(c), _number_text)[0]


def value_to_text(c: Column, dtype: T.DataType) -> Column:
    """Log text of a value of any column type."""
    if isinstance(dtype, T.DoubleType):
        return num_to_text(c)
    if isinstance(dtype, T.FloatType):
        return num_to_text(c.cast("string").cast("double"))
    if isinstance(dtype, T.DecimalType) and dtype.scale > 0:
        return F.rtrim(F.rtrim(c.cast("string"), F.lit("0")), F.lit("."))
    return c.cast("string")


def _fixed_delicate(x: Column, decimals: int) -> Column:
    """Fixed-point text of a number near an exact half, near zero, very large or not finite.

    ``scaled + error`` is the exact product of the number and the power of ten: the rounding
    error is had by splitting the number into two halves of its mantissa. A number below the
    half it shows is moved down by a few ulps.
    """
    size = F.abs(x)
    factor = F.lit(float(10 ** (decimals + 1)))
    scaled = size * factor
    spread = size * F.lit(134217729.0)  # 2^27 + 1
    high = spread - (spread - size)
    error = (high * factor - scaled) + (size - high) * factor
    shown = F.rint(scaled)
    below_half = (F.pmod(shown, F.lit(10.0)) == 5.0) & ((scaled - shown) + error < 0) & (shown / factor == size)
    return F.format_string(f"%.{decimals}f", F.when(below_half, x * F.lit(1.0 - 2.0**-50)).otherwise(x))


def fixed(c: Column, decimals: int) -> Column:
    """Fixed-point text, halves away from zero, judged on the exact binary value.

    The decimal cast rounds the shortest decimal text of a number. That is right but for
    numbers whose text shows an exact half: 1.005 is stored a little below it and must give
    1.00. Only such numbers take the long way, inside a ``transform`` over a one-element array:
    it keeps the generated method of a line with many numbers small enough for the JIT.
    """
    c = c.cast("double")
    factor = F.lit(float(10 ** (decimals + 1)))
    shown = F.rint(F.abs(c) * factor)
    shows_half = (F.pmod(shown, F.lit(10.0)) == 5.0) & (shown / factor == F.abs(c))
    delicate = shows_half | (shown < 5.0) | (shown > 1e15)
    usual = c.try_cast(f"decimal({18 + decimals},{decimals})").cast("string")
    return F.when(delicate, F.transform(F.array(c), lambda x: _fixed_delicate(x, decimals))[0]).otherwise(usual)


def fixed_or(c: Column, decimals: int, default: str = UNKNOWN) -> Column:
    return F.when(c.isNull(), F.lit(default)).otherwise(fixed(c, decimals))


def text_or(c: Column, default: str = UNKNOWN) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def preview(c: Column, limit: int = 120) -> Column:
    """A display-only cut; the text itself is kept elsewhere in full."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def question_text(name: Column, template: str) -> Column:
    """Search question of an entity; ``{name}`` in the template is replaced."""
    head, _, tail = template.partition("{name}")
    return F.concat(F.lit(head), name, F.lit(tail))


def content_text(
    name: Column,
    reference: Column,
    method: Column | None = None,
    measures: Sequence[tuple[str, Column, int, str]] = (),
) -> Column:
    """``name, reference, discovered via …, mass=… Earth masses, …`` without the null parts."""
    parts = [name, reference]
    if method is not None:
        parts.append(F.when(method != "", F.concat(F.lit("discovered via "), method)))
    for label, value, decimals, unit in measures:
        parts.append(
            F.when(
                value.isNotNull(),
                F.concat(F.lit(f"{label}="), fixed(value, decimals), F.lit(f" {unit}")),
            )
        )
    return F.concat_ws(", ", *parts)


def labelled_line(parts: Sequence[tuple[str, Column]]) -> Column:
    """``label=value, label=value`` with every value already non-null text."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{label}="), value) for label, value in parts])


def strip_fences(c: Column) -> Column:
    """Answer text without surrounding code fences."""
    cleaned = trim_all(c)
    bare = F.replace(F.replace(cleaned, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    return F.when(cleaned.startswith("```"), trim_all(bare)).otherwise(cleaned)


# What schema_of_variant names a JSON value of the wanted kind.
_JSON_KINDS = {"string": ("STRING",), "int": ("BIGINT",), "double": ("BIGINT", "DECIMAL", "DOUBLE")}


def json_field(document: Column, key: str, kind: str) -> Column:
    """One field of a parsed JSON object (a variant): missing, null or another kind gives null."""
    found = F.schema_of_variant(F.try_variant_get(document, f"$.{key}", "variant"))
    wanted = F.substring_index(found, "(", 1).isin(*_JSON_KINDS[kind])
    return F.when(wanted, F.try_variant_get(document, f"$.{key}", kind))


def split_first_comma(line: Column) -> tuple[Column, Column]:
    """Both sides of the first comma, trimmed, outer quotes removed; null without a comma."""
    at = F.locate(",", line)
    unquote = lambda c: F.btrim(trim_all(c), F.lit('"'))
    left = F.when(at > 0, unquote(F.substring(line, F.lit(1), at - 1)))
    right = F.when(at > 0, unquote(F.substring(line, at + 1, F.length(line))))
    return left, right
