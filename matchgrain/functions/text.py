"""Strings, dates, labels and fingerprints as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def unescaped(text: Column) -> Column:
    r"""``\uXXXX`` sequences as characters; text that holds none, or broken ones, stays as it is."""
    quoted = F.concat(F.lit('{"s":"'), F.replace(F.replace(text, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"}'))
    return F.when(F.contains(text, F.lit("\\u")), F.coalesce(F.from_json(quoted, "s string").s, text)).otherwise(text)


def real(text: Column) -> Column:
    """Feeds write "null" and "" for what they do not know."""
    return F.when(~F.trim(text).isin("null", ""), text)


def banned_words(text: Column, banned: Sequence[str], allowed: Sequence[str] = ()) -> Column:
    """Which banned words stand in a text as whole words, once the allowed phrases are taken out."""
    rest = F.lower(text)
    for phrase in allowed:
        rest = F.regexp_replace(rest, rf"\b{re.escape(phrase.lower())}\b", " ")
    return F.filter(F.array(*[F.when(F.regexp_like(rest, F.lit(rf"\b{re.escape(w)}\b")), F.lit(w)) for w in banned]), lambda w: w.isNotNull())


def score_of(label: Column) -> Column:
    """The two numbers at the end of "home - away, 2 - 1"."""
    at = r", (\d+) - (\d+)$"
    return F.when(F.regexp_like(label, F.lit(at)), F.struct(F.regexp_extract(label, at, 1).cast("long").alias("home"), F.regexp_extract(label, at, 2).cast("long").alias("away")))


def honest(x: Column) -> Column:
    """One figure, two where the first is a 1: what a rough number can be said to know."""
    size = F.floor(F.log10(F.abs(x)))
    first = F.floor(F.abs(x) / F.pow(F.lit(10.0), size))
    unit = F.pow(F.lit(10.0), F.when(first == 1, size - 1).otherwise(size))
    return F.when(x == 0, 0.0).otherwise(F.floor(x / unit + 0.5) * unit)


def age(born: Column, on: Column) -> Column:
    """Completed years: the birthday itself counts."""
    before = F.struct(F.month(on), F.day(on)) < F.struct(F.month(born), F.day(born))
    return F.year(on) - F.year(born) - F.when(before, 1).otherwise(0)


def season(day: Column) -> Column:
    """Seasons begin in July."""
    return F.year(F.add_months(day, -6))


def clock(text: Column) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS`` to seconds; anything else is unknown."""
    part = F.split(text, ":")
    three, two = F.size(part) == 3, F.size(part) == 2
    number = lambda i: F.try_element_at(part, F.lit(i)).try_cast("double")
    return F.when(three, number(1) * 3600 + number(2) * 60 + number(3)).when(two, number(1) * 60 + number(2))


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


#: Distance of a share from its reference at which it counts as leaning, and as far off.
LEANING, FAR = 0.05, 0.14


def band(share: Column, reference: float) -> Column:
    d = F.round(share - reference, 9)
    return F.when(d.isNull(), None).when(d >= FAR, "far above").when(d >= LEANING, "above").when(d > -LEANING, "about").when(d > -FAR, "below").otherwise("far below")


def log_ratios(parts: Sequence[Column]) -> list[Column]:
    """Isometric log-ratio coordinates of two or three positive parts."""
    logs = [F.log(p) for p in parts]
    if len(parts) == 2:
        return [(logs[0] - logs[1]) / 2**0.5]
    if len(parts) == 3:
        return [(logs[0] - logs[1]) / 2**0.5, (logs[0] + logs[1] - 2 * logs[2]) / 6**0.5]
    raise ValueError("two or three parts")


def combined_error(*errors: Column) -> Column:
    """Errors of independent parts of a sum."""
    out = errors[0] * errors[0]
    for e in errors[1:]:
        out = out + e * e
    return F.sqrt(out)


def fingerprint(*cols: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *cols), 256)


def field_paths(schema: DataType, at: str = "") -> Iterator[str]:
    """Every field of a nested schema, with its path."""
    if isinstance(schema, StructType):
        for f in schema.fields:
            yield f"{at}.{f.name}".lstrip(".")
            yield from field_paths(f.dataType, f"{at}.{f.name}")
    elif isinstance(schema, ArrayType):
        yield from field_paths(schema.elementType, f"{at}[]")
    elif isinstance(schema, MapType):
        yield from field_paths(schema.valueType, f"{at}{{}}")


#: Fixed words that no field of a result may carry.
BANNED_FIELDS = ("rating", "overall", "score_total", "rank_overall", "best_player")


def refused_fields(schema: DataType, banned: Sequence[str] = BANNED_FIELDS) -> list[str]:
    """Paths of fields whose name is a banned word, or has one between underscores."""
    whole = re.compile("|".join(rf"(?:^|_){re.escape(b)}(?:_|$)" for b in banned))
    return [p for p in field_paths(schema) if whole.search(p.rsplit(".", 1)[-1].lower())]


def inverse_erf(x: Column) -> Column:
    """Inverse error function by one closed form (Winitzki), off by less than 0.003; infinite at the ends, unknown beyond."""
    a = 0.147
    log = F.log(1 - x * x)
    b = 2 / (3.141592653589793 * a) + log / 2
    inside = F.signum(x) * F.sqrt(F.sqrt(b * b - log / a) - b)
    return F.when(F.abs(x) < 1, inside).when(F.abs(x) == 1, F.signum(x) * F.lit(float("inf")))


def table_rows(html: Column) -> Column:
    """The cells of an HTML table's rows as an array of arrays: no markup, trimmed; rows without cells are headings."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    clean = F.transform(cells, lambda row: F.transform(row, lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))))
    return F.filter(clean, lambda row: F.size(row) > 0)
