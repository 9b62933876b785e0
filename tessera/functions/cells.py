"""Cells: values with grounding excerpts, the six kinds of emptiness, and names."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cell as extracted.
CELL = "struct<answer: string, excerpts: array<struct<text: string, source: string, char_start: int, char_end: int, grounding_status: string>>>"

#: Texts that count as empty, in lower case, by policy.
EMPTY_FILTER = ["none", "n/a", "null"]
EMPTY_DISPLAY = ["", "none", "null", "undefined", "n/a", "not found", "not available", "[]", "{}"]
EMPTY_PIPELINE = ["None", "", "[]"]
EMPTY_LATER = ["not found", "n/a", "none", "unknown"]


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_empty(value: Column, policy: str = "N1") -> Column:
    """Whether a cell's text is empty: N1 filters, N2 display, N3 pipeline, N4 pipeline later on, N5 null only, N6 quality."""
    text = value.cast("string")
    low = F.lower(F.trim(text))
    if policy == "N1":
        return text.isNull() | text.isin("", "[]", "{}") | F.lower(text).isin(EMPTY_FILTER)
    if policy == "N2":
        return text.isNull() | low.isin(EMPTY_DISPLAY)
    if policy == "N3":
        return text.isNull() | text.isin(EMPTY_PIPELINE)
    if policy == "N4":
        return is_empty(value, "N3") | low.isin(EMPTY_LATER)
    if policy == "N5":
        return text.isNull()
    if policy == "N6":
        return is_empty(value, "N4") | (F.length(text) < 2)
    raise ValueError(f"unknown policy {policy}")


def unwrap(json_text: Column, keys: tuple[str, ...] = ("answer",)) -> Column:
    """The answer inside a cell given as JSON text; text that is no object, or holds no such key, stays as it is."""
    return F.coalesce(*[F.get_json_object(F.when(json_text.startswith("{"), json_text), f"$.{k}") for k in keys], json_text)


def number(value: Column) -> Column:
    """The double a text spells, null where it spells none; NaN compares with nothing, so it is null as well."""
    found = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(found), found)


def leading_number(value: Column) -> Column:
    """The number a text begins with ("12%" is 12), null without one."""
    return F.regexp_extract(value.cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def sanitise(value: Column) -> Column:
    """Text form of a number: NaN is null, infinities are words."""
    return F.when(F.isnan(value), None).when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(value.cast("string"))


def null_words(text: Column) -> Column:
    return F.when(~F.lower(text).isin("nan", "null", ""), text)


def first_of(*aliases: Column) -> Column:
    """The first alias that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in aliases])


def header(name: Column) -> Column:
    """Display form of a column name: underscores are spaces, words have capitals."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def normal_name(name: Column) -> Column:
    """Name without case, underscores, spaces and hyphens."""
    return F.regexp_replace(F.lower(name), "[_ -]", "")


def stem(file_name: Column) -> Column:
    """File name up to its first underscore, without extension: the name of its row."""
    return F.split_part(F.regexp_replace(file_name, r"\.[^.]*$", ""), F.lit("_"), F.lit(1))


def clean_name(name: Column) -> Column:
    """A proposed column name without list numbers, bullets, number signs, emphasis and doubled spaces."""
    for pattern, by in ((r"^\s*\d+[.)]\s*", ""), (r"^\s*[-*•]+\s*", ""), (r"^#+\s*", ""), (r"\*\*|__|`", ""), (r"\s+", " ")):
        name = F.regexp_replace(name, pattern, by)
    return F.trim(name)


def preview(text: Column, width: int = 97) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def value_kind(text: Column) -> Column:
    """Pattern of a value: boolean_string, numeric_string, email, url or string."""
    return (
        F.when(F.lower(text).isin("true", "false", "yes", "no"), "boolean_string")
        .when(text.rlike(r"^-?\d+(\.\d+)?$"), "numeric_string")
        .when(text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(text.rlike(r"^https?://"), "url")
        .otherwise("string")
    )


def placeholder(answer: Column, n_excerpts: Column) -> Column:
    """An answer without excerpts that says nothing was found; searched for, not matched as a whole."""
    return (n_excerpts == 0) & answer.rlike(r"(?i)(not (provided|specified|available|found|mentioned|reported|stated)|unknown|n/a|no information)")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def nested(row: Column) -> Column:
    """The data of a flat row (a map): its keys that don't begin with an underscore."""
    return F.map_filter(row, lambda k, v: ~k.startswith("_"))


def attach_source(excerpts: Column, source: Column) -> Column:
    return F.transform(excerpts, lambda x: F.struct(x.alias("text"), source.alias("source")))


def unit_name(data: Column) -> Column:
    """A row's unit: _unit_name, unit_name, else its first key that speaks of a unit or observation."""
    key = F.try_element_at(F.filter(F.array_sort(F.map_keys(data)), lambda k: F.lower(k).rlike("unit|observation")), F.lit(1))
    return F.coalesce(data["_unit_name"], data["unit_name"], data[key])


def source_document(data: Column, papers: Column) -> Column:
    return F.coalesce(data["_source_document"], data["source_document"], data["document"], F.try_element_at(papers, F.lit(1)))


def flatten_json(text: Column) -> Column:
    """A JSON list of texts joined by commas; other text as it is."""
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    return F.coalesce(F.array_join(listed, ", "), text)


def clamp(value: Column, low: float, high: float) -> Column:
    """A number, with or without a percent sign, kept within a range, as text."""
    n = number(F.regexp_replace(value, r"%\s*$", ""))
    return F.when(n < low, F.lit(float(low)).cast("string")).when(n > high, F.lit(float(high)).cast("string")).otherwise(value)


def display_order(columns: list[str]) -> list[str]:
    """Identifying columns, then those that look so, then the others by name; the directory comes last."""
    exact = ["row_name", "name", "id", "unit_name", "document"]
    rank = lambda c: (3 if c == "document_directory" else 0 if c.lower() in exact else 1 if c.lower().endswith(("_id", "_name", "key")) else 2, c.lower())
    return sorted(columns, key=rank)
