"""Cleaning of model replies that should be JSON. Each variant keeps the tolerance of its stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figloom.functions.text import strip

_BRACES = r"(?s)(\{.*\})"


def _parsed(text: Column) -> Column:
    """The text where it is JSON with an object at the top, else null."""
    return F.when(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>").isNotNull(), text)


def _braced(text: Column) -> Column:
    x = F.regexp_extract(text, _BRACES, 1)
    return F.when(x != "", x)


def _let(x: Column, then) -> Column:  # noqa: ANN001
    """``then(x)`` with ``x`` computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def relevance_reply(reply: Column) -> Column:
    """JSON text of the object with ``relevance``: fences off, else the outermost braces, else one level down; null if none.

    The text and what stands in its braces are each parsed once.
    """
    t = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")

    def pair(x: Column) -> Column:
        return F.struct(x.alias("text"), F.try_parse_json(x).alias("json"))

    def holding(p: Column) -> Column:
        return F.when(F.try_variant_get(p["json"], "$.relevance", "variant").isNotNull(), p["text"])

    def entries(p: Column) -> Column:
        return F.try_variant_get(p["json"], "$", "map<string,variant>")

    def deeper(whole: Column, inner: Column) -> Column:
        objects = F.transform(F.map_values(F.coalesce(entries(whole), entries(inner))), lambda v: F.to_json(v))
        return F.try_element_at(F.filter(objects, lambda s: s.startswith("{") & s.contains('"relevance"')), F.lit(1))

    def read(whole: Column) -> Column:
        rest = _let(pair(_braced(whole["text"])), lambda inner: F.coalesce(holding(inner), _let(pair(deeper(whole, inner)), holding)))
        return F.coalesce(holding(whole), rest)

    return _let(pair(t), read)


def annotation_reply(reply: Column) -> Column:
    """JSON text: a ```json prefix and a closing fence off, then the outermost braces; null where that is no JSON."""
    t = F.regexp_replace(F.regexp_replace(strip(reply), r"^```json\s*", ""), r"\s*```$", "")
    return F.coalesce(_parsed(_braced(t)), _parsed(t))


def checklist_reply(reply: Column) -> Column:
    """struct(json, error, raw): fence lines off, no search for braces; a null reply is null, other failures name the error."""
    t = strip(F.regexp_replace(strip(reply), r"(?m)^```(?:json)?\s*|\s*```$", ""))
    good = _parsed(t)
    return F.when(
        reply.isNotNull(),
        F.struct(
            good.alias("json"), F.when(good.isNull(), "Invalid JSON returned").alias("error"), F.when(good.isNull(), reply).alias("raw")
        ),
    )


def judge_reply(reply: Column) -> Column:
    """JSON text after fence lines are off; null asks for another try."""
    return _parsed(strip(F.regexp_replace(strip(reply), r"(?m)^```(?:json)?\s*|\s*```$", "")))


def keep_decision(reply: Column) -> Column:
    """KEEP or REJECT of a filter reply, given as a bare word or as JSON with ``decision``; null if it is neither."""
    t = F.upper(strip(reply))
    named = F.upper(F.try_variant_get(F.try_parse_json(_braced(reply)), "$.decision", "string"))
    return F.when(t.isin("KEEP", "REJECT"), t).when(named.isin("KEEP", "REJECT"), named)
