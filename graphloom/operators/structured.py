"""JSON in model replies, schema reduction, and completion with validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NOISE = ("title", "default", "examples", "example")


def extract_json(text: str) -> str:
    """A fenced block, else the outermost braces if they parse, else the text as it is."""
    if m := re.search(r"```(?:json)?\s*(.*?)\s*```", text, re.S):
        return m[1]
    a, b = text.find("{"), text.rfind("}")
    if 0 <= a < b:
        try:
            json.loads(text[a : b + 1])
        except ValueError:
            return text
        return text[a : b + 1]
    return text


def normalise_reply(body: dict[str, Any]) -> str:
    """The content of a chat-completion body as text: structures become JSON."""
    content = body["choices"][0]["message"]["content"]
    return json.dumps(content) if isinstance(content, dict | list) else extract_json(content or "")


def simplify_schema(schema: Any, keep_descriptions: bool = False, names: bool = False) -> Any:
    """A JSON schema without what a model does not need; names of fields are kept whatever they are."""
    if isinstance(schema, list):
        return [simplify_schema(x, keep_descriptions) for x in schema]
    if not isinstance(schema, dict):
        return schema
    drop = set() if names else {*_NOISE, *(() if keep_descriptions else ("description",))}
    return {k: simplify_schema(v, keep_descriptions, k in ("properties", "$defs") and not names) for k, v in schema.items() if k not in drop}


def schema_stats(schema: dict[str, Any]) -> dict[str, Any]:
    """Sizes before and after reduction, fields, nested models, depth and advice."""
    full, small = len(json.dumps(schema)), len(json.dumps(simplify_schema(schema)))
    defs = schema.get("$defs", {})

    def depth(x: Any, seen: tuple = ()) -> int:
        if isinstance(x, list):
            return max((depth(y, seen) for y in x), default=0)
        if not isinstance(x, dict):
            return 0
        if "$ref" in x:
            name = x["$ref"].rpartition("/")[2]
            return 0 if name in seen else depth(defs.get(name, {}), (*seen, name))
        inner = max((depth(v, seen) for k, v in x.items() if k != "$defs"), default=0)
        return inner + ("properties" in x)

    fields = len(schema.get("properties", {})) + sum(len(d.get("properties", {})) for d in defs.values())
    advice = "small" if small < 1500 else "moderate" if small < 4000 else "large" if small < 8000 else "split it"
    return {"raw_chars": full, "simplified_chars": small, "reduction_pct": round(100 * (1 - small / max(full, 1))), "fields": fields, "nested_models": len(defs), "depth": depth(schema), "advice": advice}


def complete(prompt: str, schema: dict[str, Any], completer: Callable[[str], str], validate: Callable[[Any], Any] = lambda x: x, retries: int = 3) -> Any:
    """Asks until the reply parses and validates, telling the model what was wrong."""
    ask, error = f"{prompt}\n\nReply with JSON of this schema:\n{json.dumps(simplify_schema(schema))}", None
    for _ in range(max(1, retries)):
        reply = completer(ask if error is None else f"{ask}\n\nThe last reply was rejected: {error}")
        try:
            return validate(json.loads(extract_json(reply)))
        except Exception as e:  # whatever the validator raises goes into the next prompt
            error = e
    raise ValueError(f"no valid reply after {retries} attempts: {error}")


def parse_replies(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """The JSON in a column of replies as a struct; NULL where it does not parse."""
    from graphloom.functions.text import json_part

    return df.withColumn("parsed", F.from_json(json_part(F.col(column)), ddl))
