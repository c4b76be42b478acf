"""JSON values as VARIANT: canonical text, checks against a schema, templates that keep native types."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a placeholder looks like, and the sentence of a prompt's output contract.
PLACEHOLDER = re.compile(r"\{([a-zA-Z0-9_.]+)\}")
CONTRACT = "Your final message MUST end with a ```json fenced block that validates against this schema:"
#: Numbers whose text a VARIANT doesn't keep: fractions, exponents, a negative zero, very long ones.
_ODD = r"[0-9][.eE]|-0|[0-9]{38}"


def dumped(value: object) -> str:
    """Canonical JSON of a Python value: sorted keys, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _retold(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else dumped(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def canonical(text: Column) -> Column:
    """JSON text of any depth with its keys sorted and no blanks; null for what isn't JSON.

    A VARIANT keeps the fields of an object in the order of their names, so most texts stay in the JVM; one Arrow pass
    gets those with numbers that a VARIANT would write otherwise, and those that it refuses (a repeated key).
    """
    plain = F.when(~text.rlike(_ODD), F.to_json(F.try_parse_json(text)))
    retold = F.pandas_udf(_retold, "string")
    return F.coalesce(plain, retold(F.when(plain.isNull(), text)))


def kind(value: Column) -> Column:
    """object, array, string, boolean, integer, number or null; a whole number with a point is a number, and no string is either."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when((name == "BIGINT") | name.rlike(r"^DECIMAL\((19|2.|3.),0\)$"), "integer")
        .otherwise("number")
    )


def _step(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"a name with a quote or backslash can't be looked up: {name}")
    return f"['{name}']"


def field(value: Column, *names: str) -> Column:
    """The VARIANT at a path of names; null where there is none (a JSON null is a VARIANT)."""
    return F.try_variant_get(value, "$" + "".join(map(_step, names)), "variant") if names else value


def _none() -> Column:
    return F.array().cast("array<string>")


def violations(value: Column, schema: dict, path: Column | None = None) -> Column:
    """Array of `path: problem` for what keeps a VARIANT from a schema of const, enum, type, required, properties, additionalProperties and items, at any depth."""
    path = F.lit("$") if path is None else path
    what, said = kind(value), F.to_json(value)
    say = lambda *parts: F.concat(path, F.lit(": "), *parts)
    found: list[Column] = []
    if "const" in schema:
        found.append(F.when(said != dumped(schema["const"]), F.array(say(F.lit(f"not {dumped(schema['const'])}")))))
    if "enum" in schema:
        found.append(F.when(~said.isin(*map(dumped, schema["enum"])), F.array(say(said, F.lit(" is not allowed")))))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        wide = [*names, "integer"] if "number" in names else names
        found.append(F.when(~what.isin(*wide), F.array(say(F.lit(f"expected {' or '.join(names)}, got "), what))))
    of_object: list[Column] = []
    for name in schema.get("required", ()):
        of_object.append(F.when(field(value, name).isNull(), F.array(say(F.lit(f"{name} is missing")))).otherwise(_none()))
    known = schema.get("properties", {})
    for name in sorted(known):
        child = field(value, name)
        of_object.append(F.when(child.isNotNull(), violations(child, known[name], F.concat(path, F.lit(f".{name}")))).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(F.json_object_keys(said), F.array(*map(F.lit, known)) if known else _none()))
        of_object.append(F.transform(F.coalesce(extra, _none()), lambda k: say(k, F.lit(" is unexpected"))))
    if of_object:
        found.append(F.when(what == "object", F.concat(*of_object)))
    if "items" in schema:
        members = F.try_variant_get(value, "$", "array<variant>")
        each = F.transform(members, lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(what == "array", F.flatten(each)))
    return F.concat(*[F.coalesce(f, _none()) for f in found]) if found else _none()


def problems(text: Column, schema: dict) -> Column:
    """violations() of a JSON text; a text that isn't JSON is named as such, a null text too."""
    return problems_of(F.try_parse_json(text), schema)


def problems_of(value: Column, schema: dict) -> Column:
    """problems() of a text that try_parse_json() has made a VARIANT of; a column of a frame is parsed once a row, an expression once for each rule."""
    return F.when(value.isNull(), F.array(F.lit("$: not JSON"))).otherwise(violations(value, schema))


def spoken(value: Column) -> Column:
    """A VARIANT as it reads within a text: strings as they are, True, False and None, else its JSON."""
    what = kind(value)
    flag = F.when(F.try_variant_get(value, "$", "boolean"), "True").otherwise("False")
    return F.when(what == "string", F.try_variant_get(value, "$", "string")).when(what == "boolean", flag).when(what == "null", "None").otherwise(F.to_json(value))


def filled(pattern: object, roots: dict[str, Column], partial: bool = False) -> Column:
    """pattern (a string, or lists and objects of strings) as a VARIANT, its {root.a.b} taken from the VARIANTs in roots.

    A string that is one placeholder keeps its value's type, objects and lists included; within a longer string the value
    is spoken. A path without a value is an error; with partial, placeholders of other roots stay as they are.
    """
    if isinstance(pattern, dict):
        parts = [filled(v, roots, partial).alias(k) for k, v in pattern.items()]
        return F.to_variant_object(F.struct(*parts)) if parts else F.parse_json(F.lit("{}"))
    if isinstance(pattern, list):
        return F.to_variant_object(F.array(*[filled(v, roots, partial) for v in pattern])) if pattern else F.parse_json(F.lit("[]"))
    if not isinstance(pattern, str):
        return F.parse_json(F.lit(json.dumps(pattern)))

    def value(path: str) -> Column | None:
        root, *names = path.split(".")
        if root not in roots:
            if partial:
                return None
            raise KeyError(f"unresolved template {{{path}}} in {pattern!r}")
        got = field(roots[root], *names)
        missing = F.raise_error(F.lit(f"unresolved template {{{path}}} in {pattern!r}")).cast("variant")
        return F.when(got.isNull(), missing).otherwise(got)

    if whole := PLACEHOLDER.fullmatch(pattern):
        got = value(whole[1])
        return F.lit(pattern).cast("variant") if got is None else got
    pieces, at = [], 0
    for m in PLACEHOLDER.finditer(pattern):
        got = value(m[1])
        if got is not None:
            pieces += [F.lit(pattern[at : m.start()]), spoken(got)]
            at = m.end()
    return F.concat(*pieces, F.lit(pattern[at:])).cast("variant")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def verdict_text(text: Column) -> Column:
    """What a model's answer says: the body of its last json fence, else the whole text without a bare fence around it; null if nothing is left."""
    fenced = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n\s*```"), F.lit(1)), F.lit(-1))
    body = stripped(text)
    inner = stripped(F.regexp_replace(body, r"(?s)^```(.*)```$", "$1"))
    bare = F.when(body.startswith("```") & body.endswith("```") & (F.length(body) >= 6), F.when(inner.startswith("json"), stripped(F.substr(inner, F.lit(5)))).otherwise(inner)).otherwise(body)
    return F.coalesce(fenced, F.nullif(bare, F.lit("")))


def envelope(text: Column) -> Column:
    """What a model's command line tells: result, session_id, is_error, subtype, status. Text that is no JSON object is the result itself."""
    value = F.try_parse_json(text)
    get = lambda name, kind_: F.try_variant_get(value, f"$.{name}", kind_)
    told = kind(value) == "object"
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(told, F.coalesce(get("result", "string"), F.lit(""))).otherwise(text).alias("result"),
        F.when(told, get("session_id", "string")).otherwise(none).alias("session_id"),
        F.when(told, F.coalesce(get("is_error", "boolean"), F.lit(False))).otherwise(False).alias("is_error"),
        F.when(told, F.coalesce(get("subtype", "string"), F.lit("success"))).otherwise("success").alias("subtype"),
        F.when(told, get("api_error_status", "int")).alias("status"),
    )


def envelope_error(exit_code: Column, told: Column) -> Column:
    """Error class of a call: out of turns, or refused for its rate or its key, is a limit; anything else amiss the backend; null where it succeeded."""
    amiss = (exit_code != 0) | told["is_error"] | (told["subtype"] != "success")
    limit = (told["subtype"] == "error_max_turns") | F.coalesce(told["status"].isin(401, 403, 429), F.lit(False))
    return F.when(amiss & limit, "agent_limit").when(amiss, "agent_backend")
