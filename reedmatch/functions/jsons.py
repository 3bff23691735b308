"""JSON columns: lenient parsing, coercion, messages of failed calls."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

#: Executors may lack this package: its functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def embedded(text: str | None) -> str | None:
    """The first JSON object inside a text, or else its first array; null if neither can be read."""
    reader = json.JSONDecoder()
    for opener in "{[":
        start = (text or "").find(opener)
        if start >= 0:
            try:
                return text[start : reader.raw_decode(text, start)[1]]
            except ValueError:
                continue
    return None


def lenient(c: Column) -> Column:
    """The JSON text inside a reply, code fences aside: its first whole object or array; null if there is
    none. Only replies that don't begin with a whole object go to Python."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", "")
    whole = F.try_parse_json(F.when(bare.startswith("{"), bare))  # reads one value, whatever follows it
    fine = whole.isNotNull()
    inside = F.pandas_udf(lambda s: pd.Series([embedded(t) for t in s], dtype=object), "string")
    return F.when(fine, F.to_json(whole)).otherwise(inside(F.when(~fine, bare)))


def entries_of(c: Column, key: str) -> Column:
    """array<string> of a key of a JSON object, whatever it holds: empty entries go, anything else that
    isn't a list becomes one entry; objects stay JSON text."""
    raw = F.get_json_object(c, f"$.{key}")
    many = F.filter(F.from_json(raw, "array<string>"), lambda x: x.isNotNull() & ~x.isin("", "null", "{}", "[]"))
    one = F.when(raw.isNull() | raw.isin("", "null", "{}", "[]", "0", "0.0", "false"), F.array().cast("array<string>")).otherwise(F.array(raw))
    return F.coalesce(F.when(raw.startswith("["), many), one)


def reply_text(body: Column) -> Column:
    """struct<text, error> of a call's response, in either of two known forms: choices with a message,
    or candidates with parts. Without text, `error` says why."""
    chosen = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    text = F.btrim(F.coalesce(chosen, F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit("")), F.lit(" \t\r\n"))
    blocked, reason = F.get_json_object(body, "$.promptFeedback.blockReason"), F.get_json_object(body, "$.candidates[0].finishReason")
    none = F.get_json_object(body, "$.candidates[0]").isNull() & chosen.isNull()
    why = (
        F.when(text != "", F.lit(None).cast("string"))
        .when(blocked.isNotNull(), F.concat(F.lit("blocked: "), blocked))
        .when(none, F.lit("no candidates"))
        .when(reason == "MAX_TOKENS", F.lit("the whole budget went into tokens before the text"))
        .otherwise(F.concat(F.lit("empty response"), F.coalesce(F.concat(F.lit(" ("), reason, F.lit(")")), F.lit(""))))
    )
    return F.struct(F.nullif(text, F.lit("")).alias("text"), why.alias("error"))


def clamped(c: Column) -> Column:
    """A score as int: truncated, 0 to 100; what is no number is 0, +-infinity is an end."""
    low = F.lower(F.trim(c.cast("string")))
    d = F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0)).otherwise(low.try_cast("double"))
    return F.when(d.isNull() | F.isnan(d), F.lit(0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), d)).cast("int"))


def strings(c: Column) -> Column:
    """array<string> of a JSON value: falsy entries go, a bare scalar is one entry."""
    many = F.from_json(c, "array<string>")
    one = F.when(c.isNull() | c.isin("", "null", '""', "0", "false"), F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(c, '^"|"$', "")))
    return F.when(c.startswith("["), F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~x.isin("", "0", "false"))).otherwise(one)


def retry_delay(header: Column, body: Column) -> Column:
    """Seconds to wait: the header, else the first retryDelay in the body's details, else what the message says, else 0."""
    details = F.coalesce(F.get_json_object(body, "$.error.details"), F.get_json_object(body, "$.details"), F.lit(""))
    detail = F.regexp_extract(details, r'"retryDelay"\s*:\s*"([0-9.]+)s?"', 1)
    said = F.regexp_extract(F.coalesce(F.get_json_object(body, "$.error.message"), body), r"(?i)retry in ([0-9.]+)", 1)
    return F.coalesce(header.try_cast("double"), detail.try_cast("double"), said.try_cast("double"), F.lit(0.0))


def refusal(label: str, status: Column, body: Column) -> Column:
    inner = F.coalesce(F.get_json_object(body, "$.error.metadata.raw"), F.get_json_object(body, "$.error.message"))
    return F.concat(F.lit(f"{label} refused (HTTP "), status.cast("string"), F.lit(")"), F.coalesce(F.concat(F.lit(": "), inner), F.lit("")))
