"""JSON documents as strings with members kept, NULL ones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def json_document(value: Column) -> Column:
    """Struct to JSON; NULL members are written out."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_json(document: Column) -> Column:
    """Whether a text is one JSON value; an object may name a member twice."""
    alone = F.json_array_length(F.concat(F.lit("["), document, F.lit("]"))) == 1
    # A quote that is left without escapes and double-quoted strings would open a single-quoted one.
    bare = F.regexp_replace(F.regexp_replace(document, r"(?s)\\.", ""), r'"[^"]*"', "")
    twice = F.try_parse_json(document).isNull() & ~bare.contains("'") & alone
    return F.coalesce(F.try_parse_json(document).isNotNull() | twice, F.lit(False))


def json_type(document: Column) -> Column:
    """'OBJECT', 'ARRAY', 'STRING', 'BOOLEAN', 'NULL' or 'NUMBER'; NULL when it is not JSON at all."""
    begin = F.substring(F.ltrim(F.regexp_replace(document, r"^\s+", "")), 1, 1)
    names = {"{": "OBJECT", "[": "ARRAY", '"': "STRING", "t": "BOOLEAN", "f": "BOOLEAN", "n": "NULL"}
    kind = F.lit("NUMBER")
    for first, name in names.items():
        kind = F.when(begin == first, name).otherwise(kind)
    return F.when(is_json(document), kind)


def json_with(document: Column, member: str, stored: Column) -> Column:
    """The JSON object ``document`` with one more member: the text ``stored`` as it is.

    What is not JSON is written as null; C7 reports it.
    """
    kept = F.when(is_json(stored), F.trim(stored)).otherwise(F.lit("null"))
    return F.concat(F.left(document, F.length(document) - 1), F.lit(f',"{member}":'), kept, F.lit("}"))


def _last_of_repeated():
    """A JSON text with each member once, the last of its name; numbers stay as written, no JSON is null."""

    def rebuilt(document):
        import json

        class Number(str):
            pass

        def no_json(name):
            raise ValueError(name)

        def text(value):
            if isinstance(value, Number):
                return str(value)
            if isinstance(value, dict):
                return "{" + ",".join(f"{json.dumps(k)}:{text(v)}" for k, v in value.items()) + "}"
            if isinstance(value, list):
                return "[" + ",".join(map(text, value)) + "]"
            return json.dumps(value)

        try:
            return None if document is None else text(json.loads(document, parse_int=Number, parse_float=Number, parse_constant=no_json))
        except (ValueError, RecursionError):
            return None

    return F.udf(rebuilt, "string")


def with_variant(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``name``: its JSON text as a variant, of members of one name the last; NULL when it is not JSON.

    A session without ``spark.sql.variant.allowDuplicateKeys`` refuses texts that repeat a member:
    there the rows that do not parse, and only they, are rebuilt in Python with each member once.
    """
    text = F.col(f"`{column}`")
    parsed = df.withColumn(name, F.try_parse_json(text))
    if df.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys") == "true":
        return parsed
    refused = F.try_parse_json(text).isNull() & text.isNotNull()
    rebuilt = df.where(refused).withColumn(name, F.try_parse_json(_last_of_repeated()(text)))
    return parsed.where(~refused).unionByName(rebuilt)
