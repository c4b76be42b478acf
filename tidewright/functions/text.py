"""Column functions over text: tokens, identifiers, hashing features, fences, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def identifiers(text: Column) -> Column:
    """Tokens of two characters at least, with camelCase and snake_case taken apart."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.regexp_extract_all(F.translate(F.lower(apart), "_", " "), F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) >= 2)


def bigrams(words: Column) -> Column:
    """Adjacent pairs joined by an underscore."""
    n = F.size(words)
    firsts, seconds = F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.when(n >= 2, F.zip_with(firsts, seconds, lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(F.array().cast("array<string>"))


def hash_slot(feature: Column, dim: int = 256) -> Column:
    """Vector index of a feature: the first nine bytes of its SHA-256, big-endian, modulo dim."""
    digest = F.sha2(feature, 256)
    if dim == 256:
        return F.conv(F.substring(digest, 17, 2), 16, 10).cast("int")
    high, low = F.conv(F.substring(digest, 1, 9), 16, 10).cast("bigint"), F.conv(F.substring(digest, 10, 9), 16, 10).cast("bigint")
    return F.pmod(F.pmod(high, F.lit(dim)) * F.lit((1 << 36) % dim) + low, F.lit(dim)).cast("int")


def hash_sign(feature: Column) -> Column:
    """1 if bit 63 of the nine bytes is set, else -1."""
    return F.when(F.conv(F.substring(F.sha2(feature, 256), 3, 1), 16, 10).cast("int") >= 8, 1).otherwise(-1)


def model_identity(dim: int = 256) -> Column:
    """Identity of the hashing embedder, under which its vectors are kept."""
    return F.sha2(F.lit(f"hashing:v1:dim={dim}"), 256)


def canonical_json(entries: dict[str, Column]) -> Column:
    """Flat object with sorted keys and no blanks; values are rendered as JSON."""
    fields = [F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(entries.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def json_text(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def last_fenced(text: Column) -> Column:
    """Body of the last json fence, or the whole text without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n\s*```"), F.lit(1)), F.lit(-1)), text)


def template(pattern: str, payload: Column, roots: tuple[str, ...] | None = None) -> Column:
    """pattern with each {a.b} replaced from the JSON payload; an unknown path is an error. With roots, placeholders of other roots stay as they are."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_][\w.]*)\}", pattern):
        if roots is not None and m[1].split(".")[0] not in roots:
            continue
        value = F.get_json_object(payload, "$." + m[1])
        parts += [F.lit(pattern[at : m.start()]), F.when(value.isNull(), F.raise_error(F.lit(f"unknown template path {m[1]}")).cast("string")).otherwise(value)]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def age(seconds: Column) -> Column:
    """Compact age: seconds below 90, minutes below 5400, hours below 172800, then days."""
    unit = lambda n, s: F.concat(F.floor(seconds / n).cast("string"), F.lit(s))
    return F.when(seconds < 90, unit(1, "s")).when(seconds < 5400, unit(60, "m")).when(seconds < 172800, unit(3600, "h")).otherwise(unit(86400, "d"))


def every_seconds(spec: Column) -> Column:
    """Seconds of 90, '30s', '5m', '6h' or '1d'; null for anything else, zero included."""
    n = F.try_element_at(F.regexp_extract_all(spec, F.lit(r"^([0-9]{1,9})[smhd]?$"), F.lit(1)), F.lit(1)).cast("bigint")
    unit = F.substring(spec, -1, 1)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(n > 0, n * factor)


def backend_error(status: Column) -> Column:
    """Error class of an HTTP status of a model backend; null where it succeeded."""
    return F.when(status.isin(401, 403, 429), "agent_limit").when((status < 200) | (status >= 300), "agent_backend")


def envelope(answer: Column) -> Column:
    """What a model's command line wraps its answer in: the result text of a JSON object, the object's own text without one, null where it reports an error."""
    result, error = F.get_json_object(answer, "$.result"), F.get_json_object(answer, "$.is_error")
    return F.when(error == "true", F.lit(None).cast("string")).otherwise(F.coalesce(result, answer))


def markdown_line(line: Column) -> Column:
    """A line of light markdown as HTML: escaped, headings, list items, bold and code."""
    text = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.regexp_replace(F.regexp_replace(text, r"\*\*([^*]+)\*\*", "<b>$1</b>"), "`([^`]+)`", "<code>$1</code>")
    return F.when(text.startswith("# "), F.concat(F.lit("<h1>"), F.substr(text, F.lit(3)), F.lit("</h1>"))).when(text.startswith("- "), F.concat(F.lit("<li>"), F.substr(text, F.lit(3)), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))
