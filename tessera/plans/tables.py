"""Queries of the table engine."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cells
from tessera.operators import filters, profile
from tessera.operators import table as paging
from tessera.operators.filters import Rule
from tessera.plans.registry import query

#: SQL of the N1 policy on a text column.
_EMPTY = "({c} IS NULL OR {c} IN ('', '[]', '{{}}') OR lower({c}) IN ('none', 'n/a', 'null'))"


def _filter(name: str, table: str, key: str, rules: list[Rule], where: str, text: str | None = None, dialect: str = "server") -> None:
    """A query of one filter: keys of the rows that pass."""
    own = f"NOT {_EMPTY.format(c=text)} AND ({where})" if text else where

    @query(name, table, f"SELECT {key} FROM {table} WHERE {own}")
    def _(df: DataFrame) -> DataFrame:
        return filters.apply_rules(df, rules, dialect).select(key)


# events.props holds JSON texts; labels join documents for real nulls
_filter("flt_05_contains", "documents", "doc_id", [Rule("text", "contains", "TION")], "contains(lower(text), 'tion')", "text")
_filter("flt_05_contains_case", "documents", "doc_id", [Rule("text", "contains", "Tion", True)], "contains(text, 'Tion')", "text")
_filter("flt_06_equals", "part", "p_partkey", [Rule("p_brand", "equals", "BRAND#12")], "lower(p_brand) = 'brand#12'", "p_brand")
_filter("flt_07_starts_with", "documents", "doc_id", [Rule("text", "startsWith", "Th", True)], "starts_with(text, 'Th')", "text")
_filter("flt_08_ends_with", "part", "p_partkey", [Rule("p_type", "endsWith", "L")], "suffix(lower(p_type), 'l')", "p_type")
_filter("flt_09_regex", "documents", "doc_id", [Rule("text", "regex", r"\d{3}-\d{4}|@")], r"regexp_matches(text, '\d{3}-\d{4}|@')", "text")
_filter("flt_09_bad_regex", "documents", "doc_id", [Rule("text", "regex", "(")], "false")
_filter("flt_10_eq", "part", "p_partkey", [Rule("p_size", "eq", "15")], "p_size = 15")
_filter("flt_11_gt", "orders", "o_orderkey", [Rule("o_totalprice", "gt", 200000)], "o_totalprice > 200000")
_filter("flt_12_lt", "orders", "o_orderkey", [Rule("o_totalprice", "lt", 50000)], "o_totalprice < 50000")
_filter("flt_13_gte", "documents", "doc_id", [Rule("n_chars", "gte", 2000)], "n_chars >= 2000")
_filter("flt_14_lte", "documents", "doc_id", [Rule("n_chars", "lte", 500)], "n_chars <= 500")
_filter("flt_15_between", "part", "p_partkey", [Rule("p_size", "between", [10, 20])], "p_size BETWEEN 10 AND 20")
_filter("flt_15_between_malformed", "part", "p_partkey", [Rule("p_size", "between", [10])], "true")
_filter("flt_16_in", "documents", "doc_id", [Rule("lang", "in", ["EN", "de"])], "lower(lang) IN ('en', 'de')", "lang")
_filter("flt_17_not_in", "documents", "doc_id", [Rule("lang", "notIn", ["en"])], "lower(lang) NOT IN ('en')", "lang")
_filter("flt_unknown_operator", "documents", "doc_id", [Rule("lang", "soundsLike", "x")], "true", "lang")
_filter("flt_20_documents", "documents", "doc_id", [Rule("source", "in", ["src1", "src2"])], "source IN ('src1', 'src2')", "source")
_filter("flt_and", "documents", "doc_id", [Rule("lang", "equals", "en"), Rule("n_chars", "gt", 1000), Rule("text", "contains", "the")], "lower(lang) = 'en' AND n_chars > 1000 AND contains(lower(text), 'the')", "text")


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query("flt_01_is_null", "documents labels", f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NULL")
def _(documents, labels):
    return filters.apply_rules(_labelled(documents, labels), [Rule("quality", "isNull")]).select("doc_id")


@query("flt_02_is_not_null", "documents labels", f"SELECT doc_id FROM {_LABELLED} WHERE quality IS NOT NULL")
def _(documents, labels):
    return filters.apply_rules(_labelled(documents, labels), [Rule("quality", "isNotNull")]).select("doc_id")


@query("flt_03_is_true", "documents labels", f"SELECT doc_id FROM {_LABELLED} WHERE toxic = 1")
def _(documents, labels):
    return filters.apply_rules(_labelled(documents, labels), [Rule("toxic", "isTrue")]).select("doc_id")


@query("flt_04_is_false", "documents labels", f"SELECT doc_id FROM {_LABELLED} WHERE toxic = 0")
def _(documents, labels):
    return filters.apply_rules(_labelled(documents, labels), [Rule("toxic", "isFalse")]).select("doc_id")


@query("flt_18_search", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'thon') OR contains(lower(source), 'thon')")
def _(documents):
    return filters.search(documents, " THON ", ["text", "source"]).select("doc_id")


@query("flt_19_search_ui", "documents", "SELECT doc_id FROM documents WHERE contains(lower(lang), 'fr') OR contains(lower(source), 'fr') OR contains(lower(text), 'fr') OR contains(n_chars::VARCHAR, 'fr')")
def _(documents):
    return filters.search(documents, "fr", ["lang", "source", "text", "n_chars"]).select("doc_id")


@query("flt_21_units", "documents", "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def _(documents):
    return documents.where(F.col("lang").isin("en", "fr")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("flt_22_placeholder", "conversations", r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)(not (provided|specified|available|found|mentioned|reported|stated)|unknown|n/a|no information)')")
def _(conversations):
    return conversations.where(cells.placeholder(F.col("text"), F.lit(0))).select("conv_id", "turn")


@query("flt_25_row_completeness", "documents labels", f"SELECT doc_id FROM {_LABELLED} WHERE ((lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) / 4.0 >= 0.7")
def _(documents, labels):
    names = ["lang", "source", "quality", "toxic"]
    share = sum((F.when(~cells.is_empty(F.col(c), "N3"), 1).otherwise(0) for c in names), F.lit(0)) / len(names)
    return _labelled(documents, labels).where(share >= 0.7).select("doc_id")


@query("flt_26_validation_rows", "documents labels", "SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM labels) WHERE n <= 3)")
def _(documents, labels):
    w = Window.partitionBy("quality").orderBy("doc_id")
    shots = labels.withColumn("n", F.row_number().over(w)).where("n <= 3")
    return labels.join(documents.select("doc_id"), "doc_id").join(shots, "doc_id", "left_anti").select("doc_id")


#: A paper's sign in SQL: RE2 knows ASCII word bounds only, so a word character of Unicode on either side is ruled out by name.
_WORDLY = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}\x{200C}\x{200D}]"


def _sign(text: str, words: str, weight: int) -> str:
    return f"CASE WHEN regexp_matches({text}, '(^|{_WORDLY})({words})($|{_WORDLY})') THEN {weight} ELSE 0 END"


@query("flt_27_paper_classifier", "documents", "SELECT doc_id, " + " + ".join([
    _sign("left(t, 2000)", "abstract", 2), _sign("left(t, 5000)", "introduction", 1), _sign("right(t, 5000)", "references?|bibliography", 2),
    _sign("t", "conclusion", 1), _sign("t", "method(s|ology)?", 1), _sign("t", "experiment(s|al)?|results?", 1),
]) + " AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def _(documents):
    return documents.select("doc_id", filters.paper_score(F.col("text")).alias("score"))


@query("flt_28_leading_number", "part", "SELECT p_partkey FROM part WHERE try_cast(nullif(regexp_extract(p_name || '', '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) >= 5 OR try_cast(nullif(regexp_extract(p_size || '%', '^\\s*([-+]?(\\d+\\.?\\d*|\\.\\d+))', 1), '') AS DOUBLE) >= 40")
def _(part):
    both = part.withColumn("share", F.concat(F.col("p_size").cast("string"), F.lit("%")))
    a = filters.compile_rule(Rule("p_name", "gte", 5), dict(both.dtypes), "ui")
    b = filters.compile_rule(Rule("share", "gte", 40), dict(both.dtypes), "ui")
    return both.where(a | b).select("p_partkey")


_SORTED = paging.TableRequest(rules=[Rule("n_chars", "gte", 500)], term="the", search_in=["text"], sort=[("quality", "asc"), ("n_chars", "desc")], documents=[f"src{i}" for i in range(10)], page=1, page_size=50)
_SCOPE = "source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9')"


def first_page(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The flagship: document filter, search, rule, sort on two columns with nulls last, one page."""
    wide = documents.join(labels, "doc_id", "left")
    return paging.Table(wide, _SORTED).page().select("doc_id", "lang", "n_chars", "quality")


query("srt_01_sorted_page", "documents labels", f"SELECT doc_id, lang, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE {_SCOPE} AND contains(lower(text), 'the') AND n_chars >= 500 ORDER BY quality IS NULL, quality, n_chars DESC, doc_id LIMIT 50 OFFSET 50")(first_page)


@query("srt_04_page_counts", "documents labels", f"SELECT count(*) AS total_count, count(*) FILTER (contains(lower(text), 'the') AND n_chars >= 500) AS filtered_count, 100 < count(*) FILTER (contains(lower(text), 'the') AND n_chars >= 500) AS has_more FROM documents WHERE {_SCOPE}")
def _(documents, labels):
    return paging.Table(documents.join(labels, "doc_id", "left"), _SORTED).counts()


@query("srt_02_text_numbers", "part", "SELECT p_partkey, p_brand FROM part ORDER BY try_cast(split_part(p_brand, '#', 2) AS DOUBLE) DESC, p_partkey LIMIT 20")
def _(part):
    keyed = part.withColumn("n", F.split_part("p_brand", F.lit("#"), F.lit(2)))
    return keyed.orderBy(*paging.sort_keys("n", "string", True), "p_partkey").limit(20).select("p_partkey", "p_brand")


@query("srt_03_ui_descending_nulls_first", "documents labels", f"SELECT doc_id, quality FROM {_LABELLED} ORDER BY quality IS NULL DESC, quality DESC, doc_id LIMIT 30")
def _(documents, labels):
    return _labelled(documents, labels).orderBy(*paging.sort_keys("quality", "int", True, "ui"), "doc_id").limit(30).select("doc_id", "quality")


@query("srt_06_top_paragraphs", "documents", "SELECT doc_id, best FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS n, p AS best FROM (SELECT doc_id, pos, p, contains(lower(p), 'the')::INT + contains(lower(p), 'tion')::INT AS hits FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> '')) AS p, generate_subscripts(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''), 1) AS pos FROM documents))) WHERE n = 1")
def _(documents):
    from tessera.functions.documents import snippets

    return documents.select("doc_id", F.explode(snippets(F.col("text"), F.array(F.lit("the"), F.lit("tion")), 1)).alias("best"))


@query("prj_03_unwrap", "events", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), props) AS value FROM events")
def _(events):
    return events.select("event_id", cells.unwrap(F.col("props"), ("answer", "k")).alias("value"))


@query("prj_04_first_alias", "part", "SELECT p_partkey, coalesce(nullif(trim(replace(p_brand, 'Brand#1', '')), ''), nullif(trim(p_type), '')) AS v FROM part")
def _(part):
    return part.select("p_partkey", cells.first_of(F.replace("p_brand", F.lit("Brand#1"), F.lit("")), F.col("p_type")).alias("v"))


@query("prj_05_sanitise", "supplier", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'Infinity' ELSE '-Infinity' END AS v FROM supplier")
def _(supplier):
    odd = F.when(F.col("s_suppkey") % 3 == 0, float("nan")).when(F.col("s_suppkey") % 3 == 1, float("inf")).otherwise(float("-inf"))
    return supplier.select("s_suppkey", cells.sanitise(odd).alias("v"))


@query("prj_09_update_cell", "customer", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'edited' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(customer):
    from tessera.operators.merge import update_cell

    return update_cell(customer, "c_mktsegment", "BUILDING", "c_mktsegment", F.lit("edited"), "c_custkey").select("c_custkey", "c_mktsegment")


@query("prj_10_header", "events", "SELECT DISTINCT event_type, upper(event_type[1]) || lower(event_type[2:]) AS header FROM events")
def _(events):
    return events.select("event_type", cells.header(F.col("event_type")).alias("header")).distinct()


@query("prj_14_column_types", "customer", "SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS name, unnest(['number', 'string', 'number', 'categorical']) AS type")
def _(customer):
    return profile.column_types(customer, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], ("c_mktsegment",))


@query("prj_15_pattern_kinds", "pages", "SELECT CASE WHEN lower(url) IN ('true', 'false', 'yes', 'no') THEN 'boolean_string' WHEN regexp_full_match(url, '-?\\d+(\\.\\d+)?') THEN 'numeric_string' WHEN regexp_full_match(url, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'email' WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'string' END AS kind, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def _(pages):
    return profile.pattern_kinds(pages, "url")


@query("prj_15_length_stats", "part", "SELECT min(length(p_name))::INT AS shortest, max(length(p_name))::INT AS longest, round(avg(length(p_name)), 6) AS mean_length, round(count(DISTINCT p_name) / count(p_name), 6) AS uniqueness FROM part")
def _(part):
    return profile.length_stats(part, "p_name")


@query("prj_18_row_name", "documents", "SELECT doc_id, split_part(regexp_replace(source || '_' || doc_id || '.txt', '\\.[^.]*$', ''), '_', 1) AS row_name FROM documents")
def _(documents):
    return documents.select("doc_id", cells.stem(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("row_name"))


@query("prj_22_preview", "documents", "SELECT doc_id, CASE WHEN length(text) > 97 THEN left(text, 97) || '...' ELSE text END AS preview FROM documents")
def _(documents):
    return documents.select("doc_id", cells.preview(F.col("text")).alias("preview"))


@query("prj_23_clean_name", "region", "SELECT r_regionkey, r_name AS name FROM region")
def _(region):
    marked = F.concat((F.col("r_regionkey") + 1).cast("string"), F.lit(". **"), F.col("r_name"), F.lit("**  "))
    return region.select("r_regionkey", cells.clean_name(marked).alias("name"))


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value FROM {_LABELLED}" for c in ("lang", "source", "quality", "toxic"))


@query("agg_01_profile", "documents labels", f"SELECT name, count(*) FILTER (value IS NOT NULL AND value NOT IN ('None', '', '[]')) AS non_null_count, count(DISTINCT coalesce(value, chr(1))) AS unique_count FROM ({_CELLS}) GROUP BY name")
def _(documents, labels):
    return profile.column_profile(_labelled(documents, labels), ["lang", "source", "quality", "toxic"])


@query("agg_02_profile_csv", "customer", "SELECT 'c_name' AS name, count(c_name) AS non_null_count, count(DISTINCT c_name) AS unique_count FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer")
def _(customer):
    return profile.column_profile(customer, ["c_name", "c_mktsegment"], "N5", nulls_distinct=False)


@query("agg_03_completeness", "documents labels", f"SELECT count(*) AS total_rows, round((count(lang) + count(source) + count(quality) + count(toxic)) * 100.0 / (count(*) * 4), 6) AS completeness FROM {_LABELLED}")
def _(documents, labels):
    return profile.completeness(_labelled(documents, labels), ["lang", "source", "quality", "toxic"])


@query("agg_05_total_documents", "documents", "SELECT count(DISTINCT source) AS total_documents FROM documents")
def _(documents):
    return profile.total_documents(documents.select(F.array("source").alias("papers")), "papers")


@query("agg_06_fullness", "documents labels", f"SELECT unnest(['lang', 'quality']) AS name, unnest([round(count(lang) * 100.0 / count(*), 1), round(count(quality) * 100.0 / count(*), 1)]) AS fullness FROM {_LABELLED}")
def _(documents, labels):
    return profile.fullness(_labelled(documents, labels), ["lang", "quality"])


@query("agg_24_numeric_range", "part", "SELECT 'p_size' AS name, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice) FROM part")
def _(part):
    return profile.numeric_range(part, ["p_size", "p_retailprice"])


@query("agg_25_distinct_values", "part", "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def _(part):
    return profile.distinct_values(part, "p_brand")


@query("win_04_unit_page", "documents", "SELECT doc_id, lang FROM documents WHERE lang IN (SELECT DISTINCT lang FROM documents ORDER BY lang LIMIT 2 OFFSET 2)")
def _(documents):
    return paging.unit_page(documents.select("doc_id", "lang"), "lang", ["doc_id"], page=1, size=2)


@query("sup_05_runs", "conversations", "SELECT conv_id, turn, role, sum(c) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations)")
def _(conversations):
    return paging.runs(conversations, ["turn"], "role", "conv_id").select("conv_id", "turn", "role", "run")
