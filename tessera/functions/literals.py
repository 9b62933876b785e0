"""Python's spelling of lists, dictionaries and texts as JSON, and excerpts in the encodings they come in.

A literal is parted into its lexemes (texts, numbers, words, signs), each is spelled in JSON, and what they make
together is checked by the JSON parser. So quotes, escapes and nesting inside texts are never mistaken for signs.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.cells import bound

_TEXT = r"'(?:[^'\\\n\r]|\\(?s:.))*+'|\"(?:[^\"\\\n\r]|\\(?s:.))*+\""
#: Lexemes: texts, numbers, the three words, a comma before an end, signs, space.
_LEXEME = rf"({_TEXT}|[-+]?(?:\d[\d_]*+\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?+|None|True|False|,(?=\s*+[\]\)}}])|[\[\](){{}},:]|\s++)"
#: Parts of a text between its quotes: escapes of each kind, and what stands for itself.
_PIECE = r"(\\U[0-9a-fA-F]{8}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\(?:\r\n|(?s:.))|[^\\]++)"
#: What a backslash and a letter stand for.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": "", "\r\n": "", "\r": ""}


def whole_json(text: Column) -> Column:
    """The text where it is one JSON value and nothing else (the parser alone takes what stands before other text)."""
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, text)


def _character(hexadecimal: Column) -> Column:
    """The character of a hexadecimal number, by its escape in JSON; two for those beyond 16 bits."""
    number = F.conv(hexadecimal, 16, 10).cast("int")
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
    return F.when(number < 0x10000, four(number)).otherwise(F.concat(four(0xD800 + F.shiftright(number - 0x10000, 10)), four(0xDC00 + (number - 0x10000).bitwiseAND(0x3FF))))


def _plain(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    return bound(F.to_json(F.struct(text.alias("x"))), lambda j: F.substr(j, F.lit(7), F.length(j) - 8))  # between {"x":" and "}


def _piece(p: Column) -> Column:
    letter = F.substring(p, 2, 2)
    out = F.when(~p.startswith("\\"), _plain(p)).when(p.rlike(r"^\\[uUx][0-9a-fA-F]{2}"), _character(F.substring(p, 3, 8))).when(p.rlike(r"^\\[0-7]"), _character(F.conv(F.substring(p, 2, 3), 8, 16)))
    for key, value in _ESCAPES.items():
        out = out.when(letter == key, _plain(F.lit(value)) if value else F.lit(""))
    return out.otherwise(F.concat(F.lit("\\\\"), _plain(letter)))


def _text(lexeme: Column) -> Column:
    inside = F.substr(lexeme, F.lit(2), F.length(lexeme) - 2)
    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(_PIECE), 1), _piece), ""), F.lit('"'))


def _number(lexeme: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(lexeme, r"_|^\+", ""), r"^(-?)\.", "$10.")
    return F.regexp_replace(F.regexp_replace(bare, r"\.(?=$|[eE])", ".0"), r"^(-?)0+(?=\d)", "$1")


def python_json(text: Column) -> Column:
    """The JSON of a Python literal of lists, tuples, dictionaries, texts, numbers, None, True and False; null for other texts.

    Tuples are lists, keys are texts. Texts that stand side by side, sets, bytes and expressions are other texts.
    """

    def spelled(lexemes: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            first = F.substring(x, 1, 1)
            after = F.get(F.filter(F.slice(lexemes, i + 2, F.lit(2)), lambda y: ~y.rlike(r"^\s")), F.lit(0))
            value = F.when(first.isin("'", '"'), _text(x)).when(first.rlike(r"[-+.\d]"), _number(x)).when(x == "None", "null").when(x == "True", "true").when(x == "False", "false").when(x == "(", "[").when(x == ")", "]").when(x.rlike(r"^\s"), " ").otherwise(x)
            key = (after == ":") & ~first.isin("'", '"') & ~first.isin(*"[](){},:") & ~x.rlike(r"^\s")
            return F.when(F.coalesce(key, F.lit(False)), F.concat(F.lit('"'), x, F.lit('"'))).when((x == ",") & F.coalesce(after.isin("]", ")", "}"), F.lit(False)), "").otherwise(value)

        return F.when(F.array_join(lexemes, "") == F.trim(text), F.array_join(F.transform(lexemes, one), ""))

    return bound(bound(F.regexp_extract_all(F.trim(text), F.lit(_LEXEME), 1), spelled), whole_json)


ITEM = "struct<text:string,source:string>"


def _item(json: Column, part: Column, source: Column, strict: bool) -> Column:
    """An excerpt from a JSON value: an object with a text, else its spelling."""
    told = F.from_json(json, "map<string,string>")
    own = F.struct(told["text"].alias("text"), told["source"].alias("source"))
    said = F.when(json.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))).otherwise(part)
    other = F.struct(said.alias("text"), source.alias("source"))
    return F.when(json.startswith("{") & F.map_contains_key(told, "text"), own).when(F.lit(strict) & ~json.startswith('"'), F.lit(None)).otherwise(other)


def excerpt_items(value: Column, source: Column) -> Column:
    """text and source of the excerpts in a cell, in any of the encodings: dictionaries in Python's spelling parted by bars, ``[source] text`` parted by bars, a JSON list, or plain text.

    ``source`` stands for one that is not told. A dictionary whose quotes are broken gives the text up to its end. Of
    a JSON list objects with a text and texts count. Null and empty cells have none.
    """
    none = F.array().cast(f"array<{ITEM}>")
    parted = F.filter(F.transform(F.split(value, " [|] "), F.trim), lambda p: p != "")
    lone = lambda p: F.struct(p.alias("text"), source.alias("source"))

    def dictionary(p: Column) -> Column:
        text = F.regexp_extract(p, r"(?s)'text'\s*:\s*'(.*?)'(?:\s*,\s*'source'|\s*\})", 1)
        own = F.nullif(F.regexp_extract(p, r"'source'\s*:\s*'(.*?)'", 1), F.lit(""))
        broken = F.when(p.rlike(r"(?s)'text'\s*:\s*'(.*?)'(?:\s*,\s*'source'|\s*\})"), F.struct(text.alias("text"), F.coalesce(own, source).alias("source"))).otherwise(lone(p))
        return bound(python_json(p), lambda j: F.when(j.isNotNull(), _item(j, p, source, False)).otherwise(broken))

    def bracketed(p: Column) -> Column:
        at = F.instr(p, "] ")
        return F.when(p.startswith("[") & (at > 0), F.struct(F.substr(p, at + 2).alias("text"), F.substr(p, F.lit(2), at - 2).alias("source"))).otherwise(lone(p))

    def listed(v: Column) -> Column:
        items = F.try_variant_get(F.try_parse_json(v), "$", "array<variant>")
        each = F.array_compact(F.transform(items, lambda x: bound(F.to_json(x), lambda j: _item(j, j, source, True))))
        scalar = F.array(lone(F.coalesce(F.try_variant_get(F.try_parse_json(v), "$", "string"), v)))
        return F.when(whole_json(v).isNull(), F.array(lone(v))).when(items.isNotNull(), each).otherwise(scalar)

    found = F.when(value.contains(" | ") & value.contains("{'text':"), F.transform(parted, dictionary)).when(value.startswith("[") & value.contains("] "), F.transform(parted, bracketed)).otherwise(listed(value))
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, none).otherwise(found)
