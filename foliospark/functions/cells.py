"""Cell semantics as Catalyst expressions: texts, formats, CSV fields and lines, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def to_double(text: Column, trimmed: bool = False) -> Column:
    """A finite double, or null; digits only where JVM casts would take suffixes, hexadecimals or padding."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "") if trimmed else text
    found = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)


def to_long(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def fixed(value: Column, decimals: Column) -> Column:
    """So many decimals, rounded half to even on the exact value; a zero has no sign. Over 17 digits the JVM's decimals stand."""
    out = F.regexp_replace(F.call_function("format_number", value, decimals), ",", "")
    return F.regexp_replace(out, r"^-(0(\.0*)?)$", "$1")


def clock(value: Column) -> Column:
    """The fraction of a day as HH:MM:SS, rounded to a second; a full day is midnight and doesn't carry."""
    seconds = F.pmod(F.round(F.pmod(value, F.lit(1.0)) * 86400).cast("bigint"), F.lit(86400).cast("bigint"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(seconds / 60) % 60), two(seconds % 60))


def calendar(value: Column, date1904: Column) -> Column:
    """The date of a serial; 1900 has its 29 February at 60."""
    days = F.floor(value).cast("bigint")
    usual = F.when(date1904, F.date_add(F.lit("1904-01-01").cast("date"), days.cast("int"))).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), (days - F.when(days > 60, 1).otherwise(0)).cast("int")))
    text = F.when(~date1904 & (days == 60), F.lit("1900-02-29")).otherwise(F.date_format(usual, "yyyy-MM-dd"))
    return F.when((days > -690_000) & (days < 2_900_000), text)


def formatted(cell: Column, date1904: Column) -> Column:
    """A number by its format's class, or null where it has none or isn't a number."""
    value = to_double(cell["raw"], trimmed=True)
    kind = F.substring_index(cell["format"], ":", 1)
    decimals = F.coalesce(F.get(F.split(cell["format"], ":"), F.lit(1)).try_cast("int"), F.lit(0))
    shown = (
        F.when(kind == "date", calendar(value, date1904))
        .when(kind == "time", clock(value))
        .when(kind == "datetime", F.concat(calendar(value, date1904), F.lit("T"), clock(value)))
        .when(kind == "percent", F.concat(fixed(value * 100, decimals), F.lit("%")))
        .when(kind == "currency", F.concat(F.lit("$"), fixed(value, decimals)))
        .when(kind == "decimal", fixed(value, decimals))
    )
    return F.when(cell["shown"].isNotNull(), cell["shown"]).when((cell["kind"] == "number") & cell["format"].isNotNull() & value.isNotNull(), shown)


def cell_text(cell: Column, date1904: Column, with_format: bool) -> Column:
    number = F.coalesce(formatted(cell, date1904), cell["raw"]) if with_format else cell["raw"]
    return (
        F.when(cell["kind"] == "string", cell["value"])
        .when(cell["kind"] == "boolean", F.when(cell["bool_value"].isNull(), cell["raw"]).otherwise(F.upper(cell["bool_value"].cast("string"))))
        .when(cell["kind"] == "number", number)
        .when(cell["kind"] == "error", cell["raw"])
        .otherwise("")
    )


def csv_field(text: Column, delimiter: str) -> Column:
    """Quoted only if it holds the delimiter, a quote or a line end."""
    special = text.contains(delimiter) | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(special, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(cells: Column, date1904: Column, delimiter: str = ",", with_format: bool = False) -> Column:
    """Each cell behind as many delimiters as its column asks; nothing after the last."""

    def field(cell: Column, i: Column) -> Column:
        gap = cell["column_index"] - F.when(i == 0, 0).otherwise(F.get(cells, i - 1)["column_index"])
        return F.concat(F.repeat(F.lit(delimiter), gap), csv_field(cell_text(cell, date1904, with_format), delimiter))

    return F.array_join(F.transform(cells, field), "")


def column_name(index: Column) -> Column:
    """The letters of a column from 0: A to XFD and, by the same rule, beyond; seven letters are enough for any column."""
    n, letters = index.cast("bigint"), []
    for k in reversed(range(7)):
        first = sum(26**j for j in range(1, k + 1))  # the first column with more than k letters
        place = F.pmod(F.floor((n - first) / 26**k), F.lit(26))
        letters.append(F.when(n >= first, F.char((place + 65).cast("bigint"))).otherwise(""))
    return F.concat(*letters)


def column_index(reference: Column) -> Column:
    """The column, from 0, of a cell reference; null without letters."""
    letters = F.upper(F.regexp_extract(reference, "^[A-Za-z]+", 0))
    codes = F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.when(letters != "", F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a * 26 + c) - 1)


def slug(name: Column) -> Column:
    """A file stem: ASCII letters and digits in lower case, all else as single hyphens within."""
    own = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(own == "", "sheet").otherwise(own)


def resolve_part(base: Column, target: Column, mode: Column) -> Column:
    """struct(part, reason): the part a relationship target leads to, or why it isn't followed."""
    own = F.regexp_replace(target, r"^\s+|\s+$", "")
    start = F.when(own.startswith("/"), F.array().cast("array<string>")).otherwise(F.filter(F.split(base, "/"), lambda p: ~p.isin("", ".")))
    steps = F.filter(F.split(own, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(
        steps,
        F.struct(start.alias("parts"), F.lit(False).alias("out")),
        lambda a, p: F.when(p == "..", F.struct(F.slice(a["parts"], F.lit(1), F.greatest(F.size(a["parts"]) - 1, F.lit(0))).alias("parts"), (a["out"] | (F.size(a["parts"]) == 0)).alias("out"))).otherwise(
            F.struct(F.concat(a["parts"], F.array(p)).alias("parts"), a["out"].alias("out"))
        ),
    )
    reason = (
        F.when(F.lower(mode) == "external", "external relationship targets are not supported")
        .when(own == "", "target is empty")
        .when(own.contains("\0"), "target contains a NUL byte")
        .when(own.contains("\\"), "backslashes are not valid OOXML part separators")
        .when(own.startswith("//") | own.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), "target is external or absolute outside the package")
        .when(walked["out"], "target escapes the OOXML package root")
        .when(F.size(walked["parts"]) == 0, "target does not resolve to an OOXML part")
    )
    return F.struct(F.when(reason.isNull(), F.array_join(walked["parts"], "/")).alias("part"), reason.alias("reason"))
