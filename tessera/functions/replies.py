"""What models reply: JSON inside prose, cells of several shapes, grades, waits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.cells import bound
from tessera.functions.literals import python_json, whole_json

#: Keys under which a cell keeps its answer and its evidence, in the order they are looked for.
ANSWER_KEYS = ["answer", "value", "response", "result", "text", "content"]
EXCERPT_KEYS = ["excerpt", "excerpts", "evidence", "sources", "quotes", "supporting_text"]
#: Phrases that tell confidence and sufficiency; the first list that applies.
CONFIDENCE_PHRASES = {
    "High": ["high confident", "very confident", "certain", "definitely"],
    "Medium": ["medium", "somewhat", "likely", "probably"],
    "Low": ["low", "uncertain", "unclear", "insufficient", "not sure"],
}
SUFFICIENCY_PHRASES = {"Insufficient": ["insufficient information", "not enough", "missing", "unclear"], "Partial": ["partially", "somewhat", "limited"]}
#: Seconds to wait by default and where an error speaks of a limit per minute.
WAIT, WAIT_MINUTE = 45, 90


def holds_any(text: Column, phrases: list[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def first_class(text: Column, classes: dict[str, list[str]], other: str) -> Column:
    """The first class of which the text, in lower case, holds a phrase."""
    low, out = F.lower(text), F.lit(other)
    for name, phrases in reversed(classes.items()):
        out = F.when(holds_any(low, phrases), name).otherwise(out)
    return out


def confidence(text: Column) -> Column:
    """High, Medium or Low by what a reply without fields says; Medium where it says nothing, also for null."""
    return first_class(F.coalesce(text, F.lit("")), CONFIDENCE_PHRASES, "Medium")


def sufficiency(answer: Column, reasoning: Column) -> Column:
    """Complete, Partial or Insufficient by what answer and reasoning say."""
    return first_class(F.concat_ws(" ", answer, reasoning), SUFFICIENCY_PHRASES, "Complete")


def parts(reply: Column) -> Column:
    """answer, confidence, reasoning, sufficiency of "answer | confidence | reasoning"; later bars belong to the reasoning, other replies are all answer."""
    cut = F.split(reply, "[|]", 3)
    whole = F.trim(reply)
    fields = F.size(cut) >= 3
    at = lambda i, other: F.when(fields, F.trim(F.get(cut, F.lit(i)))).otherwise(other)
    answer, reasoning = at(0, whole), at(2, whole)
    return F.struct(answer.alias("answer"), at(1, confidence(reply)).alias("confidence"), reasoning.alias("reasoning"), sufficiency(answer, reasoning).alias("sufficiency"))


def payload(text: Column) -> Column:
    """The JSON of a reply: inside its first fence, else the trimmed text; double braces are single."""
    fenced = F.regexp_extract(text, r"(?s)```(?:\s*json)?\s*(.*?)\s*```", 1)
    inner = F.when(text.rlike(r"(?s)```.*```"), fenced).otherwise(F.trim(text))
    return F.replace(F.replace(inner, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def repaired(text: Column) -> Column:
    """A variant of a reply's JSON, null without any: as it is, then with plain quotes and without trailing commas, then the last object in it, then closed where it was cut."""

    def tries(plain: Column) -> Column:
        last = F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))
        cut = F.regexp_extract(plain, r"(?s)([\[{].*)", 1)
        return F.array(plain, last, *[F.concat(cut, F.lit(end)) for end in ("}", '"}', "]}", '"]}', "}}", '"}}')])

    inner = payload(text)
    plain = F.regexp_replace(F.regexp_replace(inner, "[“”]", '"'), r",\s*([}\]])", "$1")
    found = F.filter(F.concat(F.array(inner), bound(plain, tries)), lambda t: t.rlike(r"(?s)^\s*[\[{]") & F.try_parse_json(t).isNotNull())
    return F.try_parse_json(F.get(found, F.lit(0)))


def _json(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def jsonified(text: Column) -> Column:
    """A cell's text as JSON: Python's spelling of a dictionary or list too; null where it is neither."""
    usable = lambda t: F.when(F.trim(t).rlike(r"^[\[{]"), F.coalesce(whole_json(t), python_json(t)))
    return bound(bound(text, usable), lambda t: F.when(F.trim(t).rlike(r"^[\[{]"), t))


def _into(as_json: Column) -> Column:
    """One step into a cell's JSON; null for null."""
    first = F.when(as_json.startswith("["), F.get_json_object(as_json, "$[0]")).otherwise(as_json)
    inside = bound(first, lambda x: F.when(x.startswith("{"), F.coalesce(*[_json(x, k) for k in ANSWER_KEYS])))
    return F.when(as_json.isNotNull(), F.coalesce(inside, F.when(as_json.startswith("["), F.array_join(F.from_json(as_json, "array<string>"), ", ")), as_json))


def _answer(cell: Column, as_json: Column) -> Column:
    return bound(F.coalesce(_into(as_json), cell), lambda d: F.coalesce(bound(jsonified(d), _into), d))


def answer_of(cell: Column) -> Column:
    """The answer in a cell's JSON text under any of its keys, an answer that is itself such a text opened once more; plain text is its own answer."""
    return bound(cell, lambda c: bound(jsonified(c), lambda j: _answer(c, j)))


def _excerpts(as_json: Column) -> Column:
    none = F.array().cast("array<string>")
    texts = lambda many: F.when(F.size(F.filter(many, lambda x: x.isNotNull())) == F.size(many), many)

    def listed(found: Column) -> Column:
        many = bound(F.when(found.startswith("["), F.from_json(found, "array<string>")), texts)
        return F.coalesce(many, F.when(F.coalesce(found, F.lit("")) != "", F.array(found)), none)

    return bound(F.coalesce(*[_json(as_json, k) for k in EXCERPT_KEYS]), listed)


def excerpts_of(cell: Column) -> Column:
    """The excerpts in a cell's JSON text under any of their keys, a lone text as one; none in plain text."""
    return bound(jsonified(cell), _excerpts)


def normal_cell(cell: Column) -> Column:
    """answer, excerpts of a cell of any known shape; its JSON is made once for both."""
    return bound(cell, lambda c: bound(jsonified(c), lambda j: F.struct(_answer(c, j).alias("answer"), _excerpts(j).alias("excerpts"))))


def display(cell: Column) -> Column:
    """What a cell shows: its answer; nothing for null; the values of an object without answer joined by commas."""

    def shown(as_json: Column) -> Column:
        named = F.coalesce(*[_json(as_json, k) for k in ("answer", "value", "text")])
        values = F.array_join(F.filter(F.map_values(F.from_json(as_json, "map<string,string>")), lambda v: v.isNotNull() & (F.trim(v) != "")), ", ")
        return F.when(as_json.startswith("["), answer_of(as_json)).otherwise(F.coalesce(bound(named, answer_of), values))

    quoted = F.nullif(F.regexp_extract(cell, r"(?s)^\s*\{\s*'text'\s*:\s*'(.*?)'\s*(?:,\s*'source'\s*:\s*'.*'\s*)?\}\s*$", 1), F.lit(""))
    return F.coalesce(bound(jsonified(cell), lambda j: F.when(j.isNotNull(), shown(j))), quoted, cell, F.lit(""))


def aspects(reply: Column) -> Column:
    """The first list of texts in a reply, in Python's spelling or JSON's; empty without any."""
    found = F.regexp_extract(reply, r"(?s)(\[\s*['\"].*?\])", 1)
    return F.coalesce(F.from_json(jsonified(found), "array<string>"), F.array().cast("array<string>"))


def grade(reply: Column) -> Column:
    """A judge's score from 0 to 10 as 0 to 1: kept within bounds, the middle where the reply holds none."""
    score = F.try_variant_get(repaired(reply), "$.score", "string").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(score, F.lit(5.0)))) / 10


def retry_wait(error: Column) -> Column:
    """Seconds that an error asks to wait, whole; a random part that spreads retries is the caller's."""
    asked = F.regexp_extract(F.lower(error), r"retry in ([\d.]+)s", 1).try_cast("double").cast("int")
    field = F.regexp_extract(error, r"(?s)retry_delay.*?seconds:\s*(\d+)", 1).try_cast("int")
    return F.coalesce(asked, field, F.when(F.lower(error).contains("per minute"), WAIT_MINUTE), F.lit(WAIT))


def used_columns(reply: Column, names: list[str]) -> Column:
    """Columns of the row that a reply seems to use: it names the column, holds a short value, or several longer words of a long value."""
    low = F.lower(reply)

    def mentioned(name: str, value: Column) -> Column:
        words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
        hits = F.size(F.filter(words, lambda w: (F.length(w) > 3) & low.contains(w)))
        long = (F.size(words) >= 3) & (hits >= F.least(F.lit(3), F.floor(F.size(words) / 2)))
        return F.when(F.trim(value) == "", False).when(low.contains(name.lower()), True).when(F.length(value) > 10, long).otherwise(low.contains(value))

    def used(name: str) -> Column:
        return bound(F.lower(answer_of(F.col(name).cast("string"))), lambda v: mentioned(name, v))

    return F.array_compact(F.array(*[F.when(F.coalesce(used(n), F.lit(False)), F.lit(n)) for n in names]))


def example_text(number: Column, paper: Column, pairs: Column, truth: Column) -> Column:
    """One example of a prompt."""
    return F.concat(F.lit("Example "), number.cast("string"), F.lit(":\nPaper: "), paper, F.lit("\nExtracted Data: "), pairs, F.lit("\nGround Truth Answer: "), F.coalesce(truth.cast("string"), F.lit("Unknown")))
