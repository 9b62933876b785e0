"""What replies propose and what is asked for: schemas and units read from replies, guidance for columns, rows of units.

Replies are a table; whoever asks the model fills it. Everything here is what stands around that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells, replies
from tessera.functions.cells import bound
from tessera.functions.literals import whole_json
from tessera.operators import quality
from tessera.operators.catalog import strategy
from tessera.operators.extract import discovery_prompt

_COLUMNS = "array<struct<name:string,definition:string,rationale:string,allowed_values:array<string>>>"
#: Names of fields that a reply's format has, so that they are no columns.
FIELDS = ["name", "definition", "rationale", "allowed_values", "document_helpful", "columns", "suggested_value_additions", "column_name", "new_values", "reason"]
#: Passages shown when a unit is looked for, and what parts the passages of a unit.
FIRST_PASSAGES, BETWEEN = 5, "\n\n--- RELEVANT PASSAGE ---\n\n"
#: Names of columns that hold no values.
NO_VALUES = ["row_name", "papers", "unit_name", "source_document", "document_directory"]


def _json(reply: Column) -> Column:
    """The JSON of a reply: all of it, else inside its first fence, else with double braces as single ones."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:\s*json)?\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(whole_json(F.trim(reply)), whole_json(fenced), whole_json(replies.payload(reply)))


def _lines(reply: Column) -> Column:
    """Columns from lines of "name: rationale"; lines of JSON and of its fields are none."""
    plain = F.filter(F.transform(F.split(reply, r"\r?\n"), F.trim), lambda x: (x != "") & ~x.isin(*"{}[],", "{}", "[]", "],", "{}[],") & ~x.rlike(r"^[{}]") & x.contains(":"))
    pair = F.transform(plain, lambda x: F.struct(F.trim(F.get(F.split(x, ":", 2), F.lit(0))).alias("name"), F.trim(F.get(F.split(x, ":", 2), F.lit(1))).alias("rationale")))
    named = F.filter(pair, lambda p: (F.length(p["name"]) >= 2) & ~p["name"].rlike('^".*"$') & ~F.lower(F.regexp_replace(p["name"], '^"+|"+$', "")).isin(FIELDS))
    return F.transform(named, lambda p: F.struct(cells.clean_name(p["name"]).alias("name"), F.lit("").alias("definition"), p["rationale"].alias("rationale"), F.lit(None).cast("array<string>").alias("allowed_values"))).cast(_COLUMNS)


def schema_reply(reply: Column) -> Column:
    """columns, document_helpful, additions (of values) that a reply proposes.

    An object with ``columns``, a bare list, or else the lines "name: rationale" of text that is neither. Without word of it
    a document is helpful; names are cleaned; nulls among allowed values go, an empty list is none. A column without a name
    makes the whole reply text. Null replies propose nothing.
    """

    def read(json: Column) -> Column:
        as_object = F.from_json(json, f"columns {_COLUMNS}, document_helpful boolean, suggested_value_additions array<struct<column_name:string,new_values:array<string>,reason:string>>")
        listed = F.when(json.startswith("["), F.from_json(json, _COLUMNS)).when(F.array_contains(F.json_object_keys(json), "columns"), F.coalesce(as_object["columns"], F.array().cast(_COLUMNS)))
        whole = F.when(~F.exists(listed, lambda c: c["name"].isNull()), listed)
        values = lambda c: F.filter(c["allowed_values"], lambda v: v.isNotNull())
        tidy = F.transform(whole, lambda c: F.struct(cells.clean_name(c["name"]).alias("name"), F.coalesce(c["definition"], F.lit("")).alias("definition"), F.coalesce(c["rationale"], F.lit("")).alias("rationale"), F.when(F.size(values(c)) > 0, values(c)).alias("allowed_values"))).cast(_COLUMNS)
        return F.struct(
            F.coalesce(tidy, _lines(reply), F.array().cast(_COLUMNS)).alias("columns"),
            F.coalesce(F.when(whole.isNotNull() & json.startswith("{"), as_object["document_helpful"]), F.lit(True)).alias("document_helpful"),
            F.coalesce(F.when(whole.isNotNull() & json.startswith("{"), as_object["suggested_value_additions"]), F.array().cast("array<struct<column_name:string,new_values:array<string>,reason:string>>")).alias("additions"),
        )

    return bound(_json(reply), read)


def unit_question(query: Column, passages: Column) -> Column:
    """mode and prompt of the question what a row stands for: by the query, the first five passages, or both; nulls where there is neither."""
    asked, some = F.length(F.trim(F.coalesce(query, F.lit("")))) > 0, F.coalesce(F.size(passages), F.lit(0)) > 0
    mode = F.when(asked & some, "STANDARD").when(some, "DOCUMENT_ONLY").when(asked, "QUERY_ONLY")
    shown = F.array_join(F.transform(F.slice(passages, 1, FIRST_PASSAGES), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), "\n\n")
    return F.struct(mode.alias("mode"), F.when(mode.isNotNull(), discovery_prompt(mode, F.trim(query), shown)).alias("prompt"))


def unit_reply(reply: Column) -> Column:
    """name, definition, example_names of the unit in a reply; null where it names none or doesn't define it."""
    got = F.from_json(_json(reply), "observation_unit struct<name:string,definition:string,example_names:array<string>>")["observation_unit"]
    told = (F.coalesce(got["name"], F.lit("")) != "") & (F.coalesce(got["definition"], F.lit("")) != "")
    return F.when(told, F.struct(got["name"].alias("name"), got["definition"].alias("definition"), F.coalesce(got["example_names"], F.array().cast("array<string>")).alias("example_names")))


def for_extraction(columns: DataFrame) -> DataFrame:
    """``columns`` (schema, name, definition, rationale) that hold values, with guidance and strategy, and with a definition and rationale where they have none.

    Columns without a name, of names that begin with an underscore, and those that only say where a row is from, are left out.
    """
    own = columns.where((F.coalesce("name", F.lit("")) != "") & ~F.lower("name").isin(NO_VALUES) & ~F.col("name").startswith("_"))
    plain, definition, rationale = F.lower(F.replace("name", F.lit("_"), F.lit(" "))), F.nullif("definition", F.lit("")), F.nullif("rationale", F.lit(""))
    both = F.concat(F.lit("Given that this column represents '"), definition, F.lit("' and is important because '"), rationale, F.lit("', carefully extract the most relevant information from the document that matches this purpose. Focus on information that directly relates to "), plain, F.lit(" as described."))
    one = F.concat(F.lit("Extract information that matches the definition: '"), definition, F.lit("'. Look for data specifically related to "), plain, F.lit("."))
    less = F.concat(F.lit("Extract relevant information for "), plain, F.lit("."))
    guidance = F.concat_ws(
        " ", F.concat(F.lit("For column '"), "name", F.lit("':")), F.concat(F.lit("Definition: "), definition), F.concat(F.lit("Purpose: "), rationale), F.coalesce(both, one, less),
        F.lit("Provide specific, factual information from the document. If the exact information is not available, return 'Not found' rather than guessing."),
    )
    filled = own.withColumn("extraction_guidance", guidance).withColumn("extraction_strategy", strategy(F.col("name"), F.col("definition"), F.col("rationale")))
    return filled.withColumn("definition", F.coalesce(definition, F.concat(F.lit("Information about "), plain))).withColumn("rationale", F.coalesce(rationale, F.concat(F.lit("Relevant data for "), plain, F.lit(" analysis"))))


def unit_requests(units: DataFrame, documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """document, unit, seq, passages (one text) of every unit to be asked about.

    ``units`` has document, seq, unit, passages (array); units without passages, and all ``known`` units (document, seq,
    unit), which stand in place of a document's own, are shown the whole text of ``documents`` (document, text).
    """
    own = units.select("document", "seq", "unit", "passages")
    if known is not None:
        given = known.select("document", "seq", "unit", F.lit(None).cast("array<string>").alias("passages"))
        own = own.join(given.select("document").distinct(), "document", "left_anti").unionByName(given)
    shown = F.when(F.coalesce(F.size("passages"), F.lit(0)) > 0, F.array_join("passages", BETWEEN)).otherwise(F.col("text"))
    return own.join(documents.select("document", "text"), "document", "left").select("document", "unit", "seq", shown.alias("passages"))


def unit_rows(answered: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of units' rows from their replies, and the values that no allowed value fits.

    ``answered`` has document, unit, seq, reply: a JSON object of columns, fenced or not; ``columns`` has column, allowed. The
    cells are document, unit, column, answer, excerpts (each with the document as its source), normalized; columns that
    nobody asked for, answers that say nothing and replies that are no object have no cells.
    """
    asked = columns.select("column", "allowed")
    cell = F.from_json(_json(F.col("reply")), "map<string,string>")
    each = answered.where("reply is not null").select("document", "unit", "seq", F.explode(cell).alias("column", "cell")).join(asked.select("column"), "column")
    shaped = each.select(F.struct("document", "seq", "unit").alias("row"), "column", replies.normal_cell(F.col("cell")).alias("c"), F.coalesce(F.get_json_object("cell", "$.suggested_for_allowed_values") == "true", F.lit(False)).alias("suggested"))
    done, waiting = quality.postprocessed(shaped.select("row", "column", "c.answer", "c.excerpts", "suggested"), asked)
    return done.select("row.document", "row.unit", "column", F.col("value").alias("answer"), cells.attach_source(F.col("excerpts"), F.col("row.document").cast("string")).alias("excerpts"), "normalized"), waiting
