"""Tolerant JSON as column expressions: what doesn't parse gives a fallback, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column, schema: str, fallback: Column) -> Column:
    """``text`` as ``schema`` (a DDL type); the fallback where it isn't such JSON."""
    valid = F.try_parse_json(text).isNotNull()
    return F.coalesce(F.when(valid, F.from_json(text, schema)), fallback)


def options(text: Column) -> Column:
    """{"A": "..", "B": ""} to an array of key and text by key; keys in upper case, blank texts dropped."""
    pairs = F.array_sort(F.map_entries(parsed(text, "map<string,string>", F.create_map().cast("map<string,string>"))))
    shown = F.transform(pairs, lambda e: F.struct(F.upper(e["key"]).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("text")))
    return F.filter(shown, lambda o: o["text"] != "")


def loose_object(text: Column) -> Column:
    """The JSON in a model's reply: the whole text, else what a code fence holds, else from the first brace to the last."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    # A text that can't begin a JSON value is not parsed: each failure would cost an exception.
    valid = lambda c: F.when(c.rlike(r"^[\s\uFEFF]*[\[{\"tfn0-9-]") & F.try_parse_json(c).isNotNull(), F.trim(c))
    return F.coalesce(valid(text), valid(fenced), valid(braces))


def messages(turns: Column, roles: tuple[str, ...] = ("user", "assistant"), last: int = 100) -> Column:
    """The last messages of a conversation with a known role and a text."""
    kept = F.filter(turns, lambda m: m["role"].isin(*roles) & (F.trim(m["text"]) != ""))
    return F.slice(kept, F.greatest(F.size(kept) - last + 1, F.lit(1)), last)


def warnings(raw: Column, most: int = 5, length: int = 200) -> Column:
    """Warnings trimmed, without blanks and repeats; the first ``most``, each cut to ``length``."""
    clean = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.transform(F.slice(F.array_distinct(clean), 1, most), lambda x: F.substring(x, 1, length))


def tags(own: Column, aliases: Column) -> Column:
    """The union of two lists in order, aliases in lower case."""
    return F.array_distinct(F.concat(own, F.transform(aliases, F.lower)))


def closed(text: str | None) -> str | None:
    """A truncated JSON text with its open string and brackets closed; a trailing comma or half a pair is dropped."""
    if text is None:
        return None
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    out = text + '"' * quoted
    out = out.rstrip().rstrip(",")
    if stack and stack[-1] == "}" and out.endswith(":"):
        out += "null"
    return out + "".join(reversed(stack))


def envelope(label: str, payload: Column) -> Column:
    """A labelled JSON payload for a model."""
    return F.concat(F.lit(f"<{label}>\n"), F.to_json(payload), F.lit(f"\n</{label}>"))
