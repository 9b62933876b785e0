"""Filter rules compiled to predicates that Catalyst pushes down where it can."""

import json
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.cells import all_of, any_of, is_empty, leading_number, number

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}
COMPARE = {"eq": "__eq__", "gt": "__gt__", "lt": "__lt__", "gte": "__ge__", "lte": "__le__"}


@dataclass(frozen=True)
class Rule:
    column: str
    operator: str
    value: Any = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class Preset:
    """Rules and sort keys under a name."""

    name: str
    rules: list[Rule] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> "Preset":
        raw = json.loads(text)
        return Preset(raw["name"], [Rule(**r) for r in raw["rules"]], [tuple(s) for s in raw["sort"]])


def _compiles(pattern: str) -> bool:
    from pyspark.errors import IllegalArgumentException
    from pyspark.sql import SparkSession

    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _float(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def compile_rule(rule: Rule, types: Mapping[str, str], dialect: str = "server", strict: bool = False) -> Column:
    """Predicate of one rule; never null.

    An empty cell fails all but ``isNull``. A numeric rule on a numeric column compares without a cast, so that it is
    pushed down; on text it parses (``ui`` dialect: what the text begins with). A malformed ``between`` and an unknown
    operator hold for every row that is not empty, as clients expect, unless ``strict``, which raises. Patterns are
    Java's, with Python's spelling of named groups; one that Java cannot compile matches nothing.
    """
    cell = F.col(rule.column)
    kind = types.get(rule.column, "string")
    empty = is_empty(cell, "N2" if dialect == "ui" else "N1")
    if rule.operator == "isNull":
        return empty
    if rule.operator == "isNotNull":
        return ~empty
    test = _test(rule, cell, kind, dialect, strict)
    if kind in NUMERIC:  # a number is empty only where it is null
        return F.coalesce(test, F.lit(False))
    return ~empty & F.coalesce(test, F.lit(False))


def _test(rule: Rule, cell: Column, kind: str, dialect: str, strict: bool) -> Column:
    op, value = rule.operator, rule.value
    text = cell.cast("string")
    if op in ("isTrue", "isFalse"):
        return text.isin(["true", "True", "1"] if op == "isTrue" else ["false", "False", "0"])
    if op in ("contains", "equals", "startsWith", "endsWith"):
        want = "" if value is None else str(value)
        left = text if rule.case_sensitive else F.lower(text)
        want = want if rule.case_sensitive else want.lower()
        return {"contains": left.contains, "equals": left.__eq__, "startsWith": left.startswith, "endsWith": left.endswith}[op](want)
    if op == "regex":
        pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", str(value).replace("(?P<", "(?<"))
        pattern = pattern if rule.case_sensitive else f"(?iu){pattern}"
        return text.rlike(pattern) if _compiles(pattern) else F.lit(False)
    if op in COMPARE or op == "between":
        have = cell if kind in NUMERIC else leading_number(cell) if dialect == "ui" else number(cell)
        if op == "between":
            if not isinstance(value, (list, tuple)) or len(value) < 2:
                if strict:
                    raise ValueError("between needs two values")
                return F.lit(True)
            low, high = _float(value[0]), _float(value[1])
            return F.lit(False) if low is None or high is None else have.between(low, high)
        want = _float(value)
        return F.lit(False) if want is None else getattr(have, COMPARE[op])(F.lit(want))
    if op in ("in", "notIn"):
        wanted = [str(v).lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
        found = F.lower(text).isin(wanted)
        return found if op == "in" else ~found
    if strict:
        raise ValueError(f"unknown operator {op}")
    return F.lit(True)


def apply_rules(df: DataFrame, rules: list[Rule], dialect: str = "server", strict: bool = False) -> DataFrame:
    """Rows that pass every rule."""
    types = dict(df.dtypes)
    return df.where(all_of([compile_rule(r, types, dialect, strict) for r in rules]))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows of which any column holds the trimmed term, without regard to case; all rows for a blank term."""
    want = (term or "").strip().lower()
    if not want:
        return df
    return df.where(any_of([F.coalesce(F.lower(F.col(c).cast("string")).contains(want), F.lit(False)) for c in columns]))


def search_map(df: DataFrame, term: str, name: str = "row_name", data: str = "data") -> DataFrame:
    """As ``search``, over a row's name and the values of its map."""
    want = (term or "").strip().lower()
    inside = F.exists(F.map_values(data), lambda v: F.coalesce(F.lower(v).contains(want), F.lit(False)))
    return df.where(F.coalesce(F.lower(F.col(name)).contains(want), F.lit(False)) | F.coalesce(inside, F.lit(False))) if want else df


def of_documents(df: DataFrame, documents: list[str], column: str = "source") -> DataFrame:
    """Rows of these documents: applied first, so that a page's total counts them only."""
    return df.where(F.col(column).isin(documents)) if documents else df


#: Patterns that mark an academic paper, the characters they are looked for in (the first ones, the last
#: ones if negative, all if none) and their weights.
PAPER_SIGNS = [
    (r"\babstract\b", 2000, 2),
    (r"\bintroduction\b", 5000, 1),
    (r"\breferences?\b|\bbibliography\b", -5000, 2),
    (r"\bconclusion\b", None, 1),
    (r"\bmethod(s|ology)?\b", None, 1),
    (r"\bexperiment(s|al)?\b|\bresults?\b", None, 1),
]


def paper_score(text: Column) -> Column:
    """Sum of the weights of the signs found in their part of the text; 4 or more make a paper."""
    low = F.lower(text)
    part = {n: low if n is None else F.substring(low, 1, n) if n > 0 else F.right(low, F.lit(-n)) for _, n, _ in PAPER_SIGNS}
    return sum((F.when(part[n].rlike(f"(?U){p}"), w).otherwise(0) for p, n, w in PAPER_SIGNS), F.lit(0))
