"""Features of columns by what their names and definitions say."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.replies import holds_any

#: Words that mark a column's domain; looked for anywhere in its text.
DOMAINS = {
    "Demographics": ["age", "gender", "sex", "race", "ethnicity", "education", "income", "occupation", "employment", "marital", "nationality", "birth", "population"],
    "Temporal": ["date", "time", "duration", "period", "year", "month", "day", "week", "timestamp", "start", "end", "interval", "frequency", "timeline"],
    "Outcomes": ["outcome", "result", "effect", "response", "success", "failure", "mortality", "survival", "improvement", "recovery", "efficacy", "performance"],
    "Methodology": ["method", "protocol", "procedure", "technique", "approach", "design", "sample", "experiment", "trial", "study", "analysis", "measurement"],
    "Identification": ["id", "identifier", "name", "title", "label", "code", "key", "reference", "index", "number", "serial"],
    "Quantitative": ["count", "amount", "quantity", "total", "sum", "average", "mean", "score", "rate", "ratio", "percentage", "value", "measure"],
    "Location": ["location", "place", "site", "region", "country", "city", "address", "geographic", "area", "zone", "territory"],
    "Classification": ["type", "category", "class", "group", "status", "level", "stage", "grade", "rank", "tier"],
}
#: Data types that are a feature each; marks for allowed values and domains weigh MARK.
TYPES, MARK = ["string", "number", "boolean", "date", "array"], 2.0
#: What a path of a local folder holds.
LOCAL = ["/app/", "/data/", "/backend/", "pending_documents", "/Users/", "/home/", "C:\\", "D:\\", "./", "../"]


def marks(text: Column, data_type: Column, allowed: Column) -> Column:
    """One-hot of the data type, then MARK for allowed values, then MARK for each domain the text speaks of."""
    low = F.lower(text)
    kinds = [F.when(F.lower(data_type) == t, 1.0).otherwise(0.0) for t in TYPES]
    listed = F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, MARK).otherwise(0.0)
    return F.array(*kinds, listed, *[F.when(F.coalesce(holds_any(low, words), F.lit(False)), MARK).otherwise(0.0) for words in DOMAINS.values()])


def is_local_path(path: Column, own: tuple[str, ...] = ()) -> Column:
    """Whether a document folder is a path of this machine rather than a name in a store; ``own`` are further folder names of an installation."""
    deep = path.startswith("/") & (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) > 2)
    return F.coalesce(holds_any(path, [*LOCAL, *own]) | deep, F.lit(False))


def fit_prompt(header: Column, blocks: Column, budget: int, caps: tuple[int, ...] = (11, 9, 7, 5, 3, 1)) -> Column:
    """A prompt of at most ``budget`` tokens (four characters each): whole, else contents cut to fewer sentences, else with papers dropped from the end, else the header, cut.

    A block's content follows "Paper content:"; other blocks are never shortened.
    """
    mark = "Paper content:"

    def shorten(block: Column, cap: int) -> Column:
        at = F.instr(block, mark)
        title = F.substring(block, F.lit(1), at + len(mark) - 1)
        said = F.split(F.trim(F.substr(block, at + len(mark))), r"(?<=[.!?])\s+")
        return F.when(at > 0, F.concat(title, F.lit(" "), F.array_join(F.slice(said, 1, cap), " "))).otherwise(block)

    join = lambda own: F.concat(header, F.lit("\n\nPapers:\n\n"), F.array_join(own, "\n\n"))
    n = F.size(blocks)
    fewer = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: join(F.slice(blocks, F.lit(1), n - k)))).otherwise(F.array().cast("array<string>"))
    shortened = lambda cap: F.transform(blocks, lambda b: shorten(b, cap))
    tried = F.concat(F.array(join(blocks), *[join(shortened(cap)) for cap in caps]), fewer)
    fits = F.filter(tried, lambda t: F.floor(F.length(t) / 4) <= budget)
    return F.coalesce(F.get(fits, F.lit(0)), F.substring(header, 1, 4 * budget))
