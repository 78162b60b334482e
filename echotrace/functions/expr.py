"""Column expressions shared by the rules; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echotrace.model import STRENGTH, Settings


def canonical(value: Column | str) -> Column:
    """Canonical decimal text of a decimal column: no exponent, no trailing zeros, any zero as 0; null stays null."""
    c = F.col(value) if isinstance(value, str) else value
    text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(c == 0, F.lit("0")).otherwise(text)


def digits(value: Column | str) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def header_text(value: Column | str) -> Column:
    """Trimmed, white space collapsed, 160 characters at most; null if nothing is left."""
    text = F.substring(F.trim(F.regexp_replace(value, r"\s+", " ")), 1, 160)
    return F.when(text != "", text)


#: A cell or range of cells in a formula, perhaps on another sheet.
OPERAND = r"(?:(?:'[^']*'|[A-Za-z0-9_.]+)!)?\$?([A-Za-z]{1,3})\$?([0-9]{1,7})(?::\$?([A-Za-z]{1,3})\$?([0-9]{1,7}))?"


def letters_number(letters: Column) -> Column:
    """A to 1, AA to 27, in either case."""
    ranks = F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: F.ascii(F.substr(F.upper(letters), i, F.lit(1))) - 64)
    return F.aggregate(ranks, F.lit(0), lambda n, x: n * 26 + x)


def operands(formula: Column) -> Column:
    """left, top, right, bottom of each cell or range that a formula names; text in quotes counts as text. A null formula names none."""
    plain = F.regexp_replace(F.coalesce(formula, F.lit("")), '"[^"]*"', '""')
    parts = F.arrays_zip(*(F.regexp_extract_all(plain, F.lit(OPERAND), F.lit(i)).alias(n) for i, n in enumerate(("a", "b", "c", "d"), 1)))

    def box(x: Column) -> Column:
        lone = F.length(x["c"]) == 0
        left, top = letters_number(x["a"]), x["b"].cast("int")
        right, bottom = F.when(lone, left).otherwise(letters_number(x["c"])), F.when(lone, top).otherwise(x["d"].cast("int"))
        return F.struct(F.least(left, right).alias("left"), F.least(top, bottom).alias("top"), F.greatest(left, right).alias("right"), F.greatest(top, bottom).alias("bottom"))

    return F.transform(parts, box)


def covers(boxes: Column, column: Column, row: Column) -> Column:
    """Whether one of the boxes holds the cell."""
    return F.exists(boxes, lambda b: column.between(b["left"], b["right"]) & row.between(b["top"], b["bottom"]))


def column_letter(number: Column | str) -> Column:
    """1 to A, 27 to AA, up to three letters."""
    n = F.col(number) if isinstance(number, str) else number
    letter = lambda x: F.chr((F.lit(65) + x).cast("long"))
    one, two = n - 1, n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def coordinate(column: Column | str, row: Column | str) -> Column:
    return F.concat(column_letter(column), (F.col(row) if isinstance(row, str) else row).cast("string"))


def close(a: Column, b: Column, settings: Settings) -> Column:
    return F.abs(a - b) <= F.lit(settings.absolute_tolerance) + F.lit(settings.relative_tolerance) * F.greatest(F.abs(a), F.abs(b))


def all_close(a: Column, b: Column, settings: Settings) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: close(x, y, settings)), lambda x: x)


def median(values: Column) -> Column:
    """Of a non-empty array of doubles; the mean of the two middle values of an even number."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(ordered, i.cast("int"))
    return F.when(n == 0, F.lit(None)).when(n % 2 == 1, at((n + 1) / 2)).otherwise((at(F.greatest(F.lit(1), n / 2)) + at(n / 2 + 1)) / 2)


def target_for(values: Column, settings: Settings) -> Column:
    """The first target that all values are close to: the configured ones in order, then the nearest integer of their median (half to even)."""
    targets = F.concat(F.array(*map(F.lit, settings.operation_targets)), F.array(F.bround(median(values), 0)))
    return F.try_element_at(F.filter(targets, lambda t: F.forall(values, lambda v: close(v, t, settings))), F.lit(1))


def informative(values: Column, zero: Column) -> Column:
    """Two values or more, two different ones, and one that is not zero."""
    return (F.size(values) >= 2) & (F.size(F.array_distinct(values)) >= 2) & F.exists(values, lambda x: x != zero)


def risk_for_run(length: Column, settings: Settings) -> Column:
    return F.when(length >= settings.high_run_length, "high").when(length >= settings.medium_run_length, "medium").otherwise("low")


def digit_risk(length: Column) -> Column:
    return F.when(length >= 8, "high").when(length >= 5, "medium").otherwise("low")


def relative_error(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.lit(0.0))


def stable_key(location: Column) -> Column:
    part = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.concat_ws("|", part(location.source_path), part(location.sheet), part(location.coordinate), F.when(location.hidden_sheet, "True").otherwise("False"))


def finding_id(rule: Column | str, keys: Column) -> Column:
    """20 hex digits of the SHA-256 of the rule and the sorted keys of its locations."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.substring(F.sha2(F.concat(rule, F.lit("\n"), F.array_join(F.array_sort(keys), "\n")), 256), 1, 20)


def strength(rule: Column) -> Column:
    out = F.lit(50)
    for name, weight in STRENGTH.items():
        out = F.when(rule == name, weight).otherwise(out)
    return out


def risk_order(risk: Column) -> Column:
    return F.when(risk == "high", 0).when(risk == "medium", 1).otherwise(2)


def series_location(side: str, begin: Column | None = None, length: Column | None = None) -> Column:
    """Location of a series struct, or of a run of it (begin counts from 1)."""
    rows, letter = F.col(f"{side}.rows"), column_letter(F.col(f"{side}.column"))
    first = F.try_element_at(rows, F.lit(1)) if begin is None else F.try_element_at(rows, begin.cast("int"))
    last = F.try_element_at(rows, F.lit(-1)) if begin is None else F.try_element_at(rows, (begin + length - 1).cast("int"))
    return F.struct(F.col(f"{side}.source_path").alias("source_path"), F.col(f"{side}.sheet").alias("sheet"), F.concat(letter, first, F.lit(":"), letter, last).alias("coordinate"), F.col(f"{side}.hidden_sheet").alias("hidden_sheet"))


def pair_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def rectangle_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two rectangles with x, y, w, h."""
    span = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    both = span("x", "w") * span("y", "h")
    return F.coalesce(F.try_divide(both.cast("double"), a["w"] * a["h"] + b["w"] * b["h"] - both), F.lit(0.0))


def compatible_aspect(w1: Column, h1: Column, w2: Column, h2: Column, turned: Column) -> Column:
    """Whether the sides' ratios differ by a factor of e^0.08 at most; a quarter turn swaps the second's sides."""
    w, h = F.when(turned, h2).otherwise(w2), F.when(turned, w2).otherwise(h2)
    return F.abs(F.log((w1 / h1) / (w / h))) <= 0.08


#: What file names tell of a picture.
ROLE_PATTERNS = (
    ("merge", r"merge[d]?|overlay|composite"),
    ("dapi", r"dapi|hoechst"),
    ("fitc", r"fitc|gfp|alexa ?488|af488|green"),
    ("tritc", r"tritc|rfp|cy3|texas ?red|alexa ?5(?:55|68|94)|red"),
    ("cy5", r"cy5|alexa ?647|af647|far ?red"),
)
DERIVED_HEADER = r"(?i)(re-?scaled|normali[sz]ed|percent|ratio|fold.?change|relative|adjusted|归一化|标准化|百分比|比值|倍数|相对|换算)"


def channel_role(name: Column | str) -> Column:
    c = F.lower(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[_\-.]+", " "))
    out = F.lit(None).cast("string")
    for role, pattern in reversed(ROLE_PATTERNS):
        out = F.when(c.rlike(rf"(^|[^a-z])({pattern})([^a-z]|$)"), role).otherwise(out)
    return out


def field_key(name: Column | str) -> Column:
    """A file name without its channel words and separators: pictures of one field share it."""
    c = F.lower(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[_\-.\s]+", " "))
    words = "|".join(p for _, p in ROLE_PATTERNS)
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"(^|(?<=[^a-z]))({words})($|(?=[^a-z]))", " "), r"\s+", " "))


def magnification(name: Column | str) -> Column:
    """The number before x, as in 20x; null if there is none from 1 to 1000."""
    found = F.regexp_extract(name, r"(?i)(?:^|[^0-9a-z.])([0-9]{1,4}(?:\.[0-9]+)?)\s*[x×](?:[^a-z0-9]|$)", 1)
    n = F.when(found != "", found.cast("double"))
    return F.when(n.between(1, 1000), n)
