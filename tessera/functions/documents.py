"""Texts of documents: cleaning, sentences, chunks, tables, keywords, tokens."""

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from tessera.functions.cells import bound

#: Headings that begin references and acknowledgments.
REFERENCE_HEADINGS = [r"(?im)^\s*(?:\d+\.?\s+)?references?\s*$", r"(?im)^\s*bibliography\s*$", r"(?im)^\s*literature\s+cited\s*$", r"(?i)\\section\*?\{references?\}"]
ACKNOWLEDGMENTS = [r"(?im)^\s*acknowledgments?\s*$", r"(?im)^\s*acknowledgements?\s*$"]
CAPTION = re.compile(r"^\s*table\s+\d+", re.I)


def sentences(text: Column) -> Column:
    """Split after a full stop, question or exclamation mark and white space."""
    return F.split(text, r"(?<=[.?!])\s+")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")


def structural(text: Column) -> Column:
    """Split before headings and captions."""
    return F.filter(F.split(text, r"(?m)(?=^(?:#{1,6} |(?:Table|Figure) \d+|[A-Z][A-Z ]{3,}$))"), lambda p: F.trim(p) != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def windows(items: Column, width: int, overlap: int) -> Column:
    """Overlapping slices of an array; none of an empty one."""
    step = width - overlap

    def sliced(items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(step))
        return F.when(F.size(items) > 0, F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(width)))).otherwise(F.array().cast("array<array<string>>"))

    return bound(items, sliced)  # else the array would be made again for every slice


def packs(text: Column, width: int) -> Column:
    """Sentences packed in order into passages of ``width`` words at most; a longer sentence is cut.

    Only the sizes of sentences are folded, to the places where passages begin; the words are sliced once.
    """
    by_sentence = F.transform(sentences(text), words)
    cut = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(width)), lambda i: F.least(F.lit(width), n - i))).otherwise(F.array().cast("array<int>"))
    sizes = F.flatten(F.transform(by_sentence, lambda s: cut(F.size(s))))
    start = F.struct(F.array(F.lit(0)).alias("begin"), F.lit(0).alias("now"), F.lit(0).alias("all"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["now"] + n <= width
        return F.struct(F.when(fits, acc["begin"]).otherwise(F.array_append(acc["begin"], acc["all"])).alias("begin"), F.when(fits, acc["now"] + n).otherwise(n).alias("now"), (acc["all"] + n).alias("all"))

    places = F.aggregate(sizes, start, step)
    one = F.array(F.struct(F.flatten(by_sentence).alias("w"), places["begin"].alias("begin"), places["all"].alias("all")))
    sliced = F.transform(one, lambda x: F.transform(x["begin"], lambda b, i: F.slice(x["w"], b + 1, F.coalesce(F.get(x["begin"], i + 1), x["all"]) - b)))
    return F.filter(F.flatten(sliced), lambda p: F.size(p) > 0)


def chunks(text: Column, width: int, overlap: int = 64) -> Column:
    """Passages of ``width`` words: packed sentences, each under overlapping windows."""
    return F.transform(F.flatten(F.transform(packs(text, width), lambda p: windows(p, width, overlap))), lambda w: F.array_join(w, " "))


def chunk_width(max_words: int, k: int) -> int:
    return max(int(max_words / k), 128)


def token_count(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def keywords(text: Column) -> Column:
    """Distinct words of letters, digits and underscores of more than two characters, in lower case."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0)), lambda w: F.length(w) > 2)


def snippets(text: Column, terms: Column, most: int = 8) -> Column:
    """The paragraphs with most keywords, earlier ones first among equals."""
    parts = paragraphs(text)
    scored = F.transform(parts, lambda p, i: F.struct((-F.size(F.filter(terms, lambda t: F.lower(p).contains(t)))).alias("score"), i.alias("at"), p.alias("text")))
    return F.transform(F.slice(F.array_sort(scored), 1, most), lambda s: s["text"])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_references(text: Column) -> Column:
    """Text before the first kind of reference heading whose first place is after 70 % of the text, stripped."""

    def cut(t: Column) -> Column:
        places = F.array(*[F.regexp_instr(t, F.lit(p)) for p in REFERENCE_HEADINGS])
        late = F.filter(places, lambda at: at - 1 > 0.7 * F.length(t))
        return F.when(F.size(late) > 0, stripped(F.substring(t, F.lit(1), F.get(late, F.lit(0)) - 1))).otherwise(t)

    return bound(text, cut)


def without_acknowledgments(text: Column) -> Column:
    """Text without the section of acknowledgments: to the next line that begins with a word, or to the end after 80 %."""

    def cut(t: Column, pattern: str) -> Column:
        def at_heading(at: Column) -> Column:
            before = F.substring(t, F.lit(1), at - 1)
            rest = F.substr(t, at + F.length(F.regexp_extract(t, pattern, 0)))
            then = F.regexp_instr(rest, F.lit(r"(?im)^\s*(?:\d+\.?\s+)?[A-Z][a-z]+"))
            return F.when(then > 0, F.concat(before, F.substr(rest, then))).when(at - 1 > 0.8 * F.length(t), before).otherwise(t)

        return bound(F.regexp_instr(t, F.lit(pattern)), lambda at: F.when(at == 0, t).otherwise(at_heading(at)))

    first, second = ACKNOWLEDGMENTS
    return bound(text, lambda t: bound(cut(t, first), lambda u: cut(u, second)))


def preprocess(text: Column, paper: Column) -> Column:
    """Papers (``paper`` says which) of 1000 characters or more lose references and acknowledgments; other texts stay."""
    return F.when((F.length(text) >= 1000) & paper, stripped(without_acknowledgments(without_references(text)))).otherwise(text)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\w\s.-]", ""), r"\s+", "_")


def nfkc(text: Column) -> Column:
    """Unicode normal form KC (ICU's, which Spark carries) without control characters but line breaks and tabs."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.isNotNull(), F.regexp_replace(composed, r"[\p{Cc}&&[^\n\t]]", ""))


def line_cells(line: Column) -> Column:
    """``cells_of`` as a column: by bars, else tabs, else two spaces or more."""
    cut = F.when(line.contains("|"), F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), "[|]")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(F.trim(line), " {2,}"))
    return F.transform(cut, lambda c: F.trim(c))


def cells_of(line: str) -> list[str]:
    """Cells of a table's line: by bars, else tabs, else two spaces or more."""
    if "|" in line:
        return [c.strip() for c in line.strip().strip("|").split("|")]
    return [c.strip() for c in (line.split("\t") if "\t" in line else re.split(r" {2,}", line.strip()))]


def find_tables(text: str | None) -> list[tuple[str, list[list[str]]]]:
    """Caption and rows of each table: a caption line, then three lines or more of two cells or more."""
    lines, out, i = (text or "").split("\n"), [], 0
    while i < len(lines):
        if not CAPTION.match(lines[i]):
            i += 1
            continue
        caption, rows, j = lines[i].strip(), [], i + 1
        while j < len(lines):
            line = lines[j]
            if not line.strip():
                if rows:
                    break
                j += 1
                continue
            cells = cells_of(line)
            if len(cells) < 2 or CAPTION.match(line) or line.strip().isupper() and len(cells) < 2:
                break
            if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells):
                rows.append(cells)
            j += 1
        if len(rows) >= 3:
            out.append((caption, rows))
        i = max(j, i + 1)
    return out


def markdown(caption: str, rows: list[list[str]]) -> str:
    """A table as Markdown, short rows padded, the caption in bold."""
    width = max(len(r) for r in rows)
    full = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([f"**{caption}**", "", line(full[0]), "|" + " --- |" * width, *map(line, full[1:])])


@udtf(returnType=StructType().add("caption", StringType()).add("n_rows", IntegerType()).add("n_columns", IntegerType()).add("markdown", StringType()))
class DetectTables:
    def eval(self, text: str) -> Iterator[tuple]:
        for caption, rows in find_tables(text):
            yield caption, len(rows), max(len(r) for r in rows), markdown(caption, rows)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags gone, common entities resolved, spaces folded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))
