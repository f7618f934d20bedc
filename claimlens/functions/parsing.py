"""JSON that models and search services send, read with defaults; what isn't JSON gives the default, never an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CONFIDENCES, LABELS
from .text import bound, strip

CLAIMS = "array<struct<text string, context string, category string, is_checkable boolean>>"
VERDICT = "struct<label string, confidence string, explanation string, support_count int, contradict_count int>"
RESULTS = "struct<web: struct<results: array<struct<url: string, title: string, description: string>>>>"
#: Claims taken from one answer.
MOST_CLAIMS = 30
FAILED = "Parse error or API failure."
#: What counts as yes and as no where a flag is given as a text or a number.
YES, NO = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def unfenced(x: Column) -> Column:
    """An answer without the code fence it may stand in."""

    def bare(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"```(?:json)?\s*", ""), r"\s*`*\s*$", "")
        return F.when(F.startswith(x, F.lit("```")), strip(inner)).otherwise(x)

    return bound(strip(x), bare)


def _valid(x: Column, first: str) -> Column:
    """x without outer white space if it is JSON and starts as it should, else null.

    The engine's parser stops where a value ends, so brackets outside of strings have to be as many as their
    counterparts, and the last character one of them.
    """

    def told(x: Column) -> Column:
        def closed(bare: Column) -> Column:
            many = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
            return (many("{") == many("}")) & (many("[") == many("]"))

        whole = F.endswith(x, F.lit("]" if first == "[" else "}")) & bound(F.regexp_replace(x, r'"(?:\\.|[^"\\])*"', ""), closed)
        return F.when(F.startswith(x, F.lit(first)) & whole & F.try_parse_json(x).isNotNull(), x)

    return bound(strip(x), told)


def _flag(value: Column, kind: Column) -> Column:
    """A yes-or-no value in any of its forms; null if it is none."""
    low = F.lower(F.try_variant_get(value, "$", "string"))
    given = (kind == "BOOLEAN") | (kind == "STRING") | kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(given & low.isin(*YES, "1.0"), True).when(given & low.isin(*NO, "0.0"), False)


def claims_of_answer(x: Column, most: int = MOST_CLAIMS) -> Column:
    """The first claims of an answer that is a plain JSON list, their texts stripped; none at all if one of these is no claim.

    A claim is an object whose text is a string that isn't blank, whose context and category are strings or left out or null,
    and whose is_checkable is left out (then it is checkable) or says yes or no, but isn't null.  A fenced answer is no list.
    """
    items = F.slice(F.try_variant_get(F.try_parse_json(_valid(x, "[")), "$", "array<variant>"), 1, most)

    def read(item: Column) -> Column:
        values = {name: F.try_variant_get(item, f"$.{name}", "variant") for name in ("text", "context", "category", "is_checkable")}
        kinds = {name: F.coalesce(F.schema_of_variant(v), F.lit("NONE")) for name, v in values.items()}
        text = F.when(kinds["text"] == "STRING", strip(F.try_variant_get(item, "$.text", "string")))
        said = F.when(kinds["is_checkable"] == "NONE", True).otherwise(_flag(values["is_checkable"], kinds["is_checkable"]))
        optional = [kinds[name].isin("STRING", "NONE", "VOID") for name in ("context", "category")]
        good = reduce(Column.__and__, optional) & said.isNotNull() & (text != "")
        strings = [F.try_variant_get(item, f"$.{name}", "string").alias(name) for name in ("context", "category")]
        return F.when(F.coalesce(good, F.lit(False)), F.struct(text.alias("text"), *strings, said.alias("is_checkable")))

    found = bound(F.transform(items, read), lambda c: F.when(~F.exists(c, lambda v: v.isNull()), c))
    return F.coalesce(found, F.array()).cast(CLAIMS)


def items_of_answer(x: Column) -> Column:
    """The items of an answer that is a JSON list, fenced or not, however many, as they are; none of what is no list.

    What an item lacks, or has of another kind, is null; is_checkable is true unless the item says otherwise.
    """
    items = F.try_variant_get(F.try_parse_json(_valid(unfenced(x), "[")), "$", "array<variant>")
    text = lambda item, name: F.when(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) == "STRING", F.try_variant_get(item, f"$.{name}", "string")).alias(name)
    said = lambda item: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(item, "$.is_checkable", "variant")) == "BOOLEAN", F.try_variant_get(item, "$.is_checkable", "boolean")), F.lit(True)).alias("is_checkable")
    return F.coalesce(F.transform(items, lambda i: F.struct(text(i, "text"), text(i, "context"), text(i, "category"), said(i))), F.array()).cast(CLAIMS)


def verdict_of_answer(x: Column) -> Column:
    """A verdict object with defaults for what it lacks (what is null stays null), and a failure's verdict for what is no object."""
    defaults = (("label", "Unverifiable"), ("confidence", "Low"), ("explanation", ""), ("support_count", 0), ("contradict_count", 0))
    failed = F.struct(*(F.lit(FAILED if name == "explanation" else value).alias(name) for name, value in defaults))

    def read(both: Column) -> Column:
        null = lambda name: F.is_variant_null(F.try_variant_get(both["all"], f"$.{name}", "variant"))
        fields = [F.when(~F.coalesce(null(name), F.lit(False)), F.coalesce(both["told"][name], F.lit(value))).alias(name) for name, value in defaults]
        return F.when(both["all"].isNotNull(), F.struct(*fields)).otherwise(failed)

    return bound(bound(_valid(unfenced(x), "{"), lambda v: F.struct(F.try_parse_json(v).alias("all"), F.from_json(v, VERDICT).alias("told"))), read)


def known(label: Column, confidence: Column) -> Column:
    """Whether a verdict's label and confidence are ones that there are; others fall back to a stub's verdict."""
    return F.coalesce(label.isin([x[0] for x in LABELS]) & confidence.isin(CONFIDENCES), F.lit(False))


def last_object(x: Column) -> Column:
    """The last object of a free text, from its last opening brace that is closed; null if that isn't JSON (as of nested objects)."""
    return _valid(F.regexp_extract(x, r"(?s)^.*(\{[^{]*\})", 1), "{")


def array_within(x: Column) -> Column:
    """A text that is an array, or its part from the first opening to the last closing bracket; null if neither is JSON."""
    return F.coalesce(_valid(x, "["), _valid(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "["))


def search_results(x: Column) -> Column:
    """The results (url, title, description) of a search answer, in order; none if there are none."""
    kind = "array<struct<url string, title string, description string>>"
    return F.coalesce(F.from_json(_valid(x, "{"), RESULTS)["web"]["results"], F.array().cast(kind))
