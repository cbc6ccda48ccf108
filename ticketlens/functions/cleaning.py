"""Column expressions that type and clean raw service-desk cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title prefixes that mail clients put in front of a subject.
TITLE_PREFIXES = ("tr", "re", "fwd", "fw")
# Texts read as booleans, and texts read as "no name".
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off", "", "none", "nan")
NO_NAME = ("", "nan", "none", "<na>")
# Keys that stand for an object cell, most specific first.
OBJECT_KEYS = ("id", "name", "completename")


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_title(c: Column) -> Column:
    prefixes = "|".join(TITLE_PREFIXES)
    lowered = F.lower(strip(F.coalesce(c, F.lit(""))))
    return strip(F.regexp_replace(lowered, rf"(?U)^(?:\s*(?:{prefixes})\s*:\s*)+", ""))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _from_object(v: Column) -> Column:
    return F.coalesce(*[_filled(F.try_variant_get(v, f"$.{key}", "string")) for key in OBJECT_KEYS])


def _first_in_list(items: Column, steps: Column) -> Column:
    """The first filled value of a list, depth first, through lists nested to any depth.

    An explicit stack of the values still to visit is worked off by ``aggregate``: a list puts
    its items in front of the stack, an object gives its first filled key, a scalar itself when
    it is not empty. ``steps`` bounds the number of list items in the cell.
    """
    start = F.struct(items.alias("stack"), F.lit(None).cast("string").alias("found"))

    def visit(acc, _):
        top = F.get(acc["stack"], F.lit(0))
        rest = F.slice(acc["stack"], 2, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))
        kind = F.schema_of_variant(top)
        inner = F.coalesce(F.try_variant_get(top, "$", "array<variant>"), F.array().cast("array<variant>"))
        value = F.when(kind.startswith("OBJECT"), _from_object(top)).when(
            ~kind.startswith("ARRAY"), _filled(F.try_variant_get(top, "$", "string"))
        )
        idle = acc["found"].isNotNull() | (F.size(acc["stack"]) == 0)
        return F.when(idle, acc).otherwise(
            F.struct(
                F.when(kind.startswith("ARRAY"), F.concat(inner, rest)).otherwise(rest).alias("stack"),
                value.alias("found"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), steps), start, visit)["found"]


def _flatten_variant(v: Column, steps: Column) -> Column:
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    scalar = F.try_variant_get(v, "$", "string")
    return F.when(kind.startswith("OBJECT"), _from_object(v)).when(
        kind.startswith("ARRAY"), _first_in_list(items, steps)
    ).otherwise(scalar)


def flatten_cell(c: Column) -> Column:
    """Reduce a landed cell to one scalar text.

    A list gives its first element that is not empty (lists inside lists to any depth), an
    object its first filled key of ``OBJECT_KEYS``; anything that is not JSON is already the
    scalar.
    """
    # a list item stands behind a bracket or a comma; the walk takes one step an item
    steps = F.greatest(F.length(c) - F.length(F.translate(c, "[,", "")), F.lit(1))
    # parsed once: the lambda binds the value that the branches below look at several times
    held = F.transform(
        F.array(F.try_parse_json(c)),
        lambda v: F.when(v.isNotNull(), _flatten_variant(v, steps)).otherwise(c),
    )
    return F.when(c.rlike(r"^\s*[\[{]"), F.get(held, F.lit(0))).otherwise(c)


def whole_number(c: Column) -> Column:
    """Numeric text to BIGINT, anything else to NULL.

    The patterns come first because a failing cast is far dearer than a failing match.
    """
    number = c.try_cast("double")
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("bigint")).when(
        c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"),
        F.when(number == F.floor(number), number.try_cast("bigint")),
    )


# Layouts tried in this order after ISO text; month first, as the reference reads
# an ambiguous slash date, day first when that is no date, then year first and dotted days.
DATE_FORMATS = (
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy",
)


def lenient_timestamp(c: Column) -> Column:
    """ISO text, else the first of ``DATE_FORMATS`` that reads the whole cell; else NULL."""
    text = strip(c.cast("string"))
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]
    return F.coalesce(c.cast("string").try_cast("timestamp_ntz"), *tried)


def coerce_bool(c: Column) -> Column:
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def normalize_display_name(c: Column) -> Column:
    squeezed = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    spaced = F.lower(F.regexp_replace(squeezed, " ?> ?", " > "))
    return F.when(~F.lower(squeezed).isin(*NO_NAME), spaced)


def json_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
