"""Scalar text functions, all built of engine expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.canonical import canonical as canonical_json

# Spellings of media types and the file endings of the usual ones.
MIME_ALIASES = {"image/jpg": "image/jpeg", "text/json": "application/json", "application/x-json": "application/json", "text/x-csv": "text/csv", "application/csv": "text/csv"}
EXTENSIONS = {"application/json": ".json", "text/csv": ".csv", "text/plain": ".txt", "application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "text/html": ".html", "application/zip": ".zip"}
TYPE_ORDER = ["null", "boolean", "number", "string", "array", "object"]


def lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), default)


def normal_mime(c: Column) -> Column:
    """Lower case, without parameters, aliases resolved."""
    base = F.trim(F.substring_index(F.lower(F.trim(c)), ";", 1))
    return lookup(base, MIME_ALIASES, base)


def is_json_mime(c: Column) -> Column:
    base = normal_mime(c)
    return (base == "application/json") | F.endswith(base, F.lit("+json"))


def extension(c: Column) -> Column:
    return lookup(normal_mime(c), EXTENSIONS, F.lit(".bin"))


def safe_filename(name: Column, mime: Column) -> Column:
    """A name of letters, digits, dots, dashes and underlines, with the ending of its media type."""
    return F.concat(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), F.coalesce(extension(mime), F.lit(".bin")))


def path_step(name: Column) -> Column:
    """``.name`` for identifiers, ``['name']`` with escapes otherwise."""
    escaped = name
    for raw, shown in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.when(F.rlike(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")), F.concat(F.lit("."), name)).otherwise(F.concat(F.lit("['"), escaped, F.lit("']")))


def truncated(c: Column, most: int = 30) -> Column:
    """``[head](N more chars truncated)`` for longer text."""
    return F.when(F.length(c) > most, F.concat(F.lit("["), F.left(c, F.lit(most)), F.lit("]("), (F.length(c) - most).cast("string"), F.lit(" more chars truncated)"))).otherwise(c)


def short_hash(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def base64url(c: Column) -> Column:
    """Base 64 for addresses, without padding."""
    return F.regexp_replace(F.translate(F.base64(c), "+/", "-_"), "[=\\s]", "")


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[-_. ]", "")


def query_parameters(url: Column) -> Column:
    """The parameters of an address as a map, decoded; the last of equal names counts."""
    pairs = F.filter(F.split(F.parse_url(url, F.lit("QUERY")), "&"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    return F.aggregate(entries, F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def link_next(header: Column) -> Column:
    """The address with rel=next of a Link header."""
    return F.nullif(F.regexp_extract(header, '<([^>]*)>[^,]*;\\s*rel="?next"?', 1), F.lit(""))


def probe_hashes(data: Column, n: int = 4096) -> Column:
    """Hashes of the head and the tail of binary content."""
    return F.struct(F.sha2(F.substring(data, 1, n), 256).alias("head"), F.sha2(F.when(F.length(data) > n, F.substring(data, -n, n)).otherwise(data), 256).alias("tail"))


def cli_flags(line: Column) -> Column:
    """``--name value`` and ``--name=value`` of a command line as a map; the last of equal names counts."""
    names = F.regexp_extract_all(line, F.lit("--([A-Za-z][\\w-]*)[= ]([^\\s-][^\\s]*)"), 1)
    values = F.regexp_extract_all(line, F.lit("--([A-Za-z][\\w-]*)[= ]([^\\s-][^\\s]*)"), 2)
    return F.aggregate(F.arrays_zip(names.alias("k"), values.alias("v")), F.expr("cast(map() as map<string,string>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def truncated_bytes(c: Column, most: int) -> Column:
    """Text cut to at most ``most`` bytes, never within a character."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most)
    whole = F.regexp_replace(F.try_validate_utf8(cut.cast("string")), "�+$", "")
    shorter = [F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), 1, most - i).cast("string")) for i in range(1, 4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(whole, *shorter))


def request_identity(upstream: str, prefix: str, tool: str, args: str) -> Column:
    """A hash that names a request: the same for all serialisations of its arguments (JSON text, null for none)."""
    canonical = canonical_json(F.coalesce(F.col(args), F.lit("{}")))
    return F.sha2(F.concat_ws("|", F.coalesce(upstream, F.lit("")), F.coalesce(prefix, F.lit("")), F.coalesce(tool, F.lit("")), canonical), 256)


def utc_time(text: Column) -> Column:
    """An ISO time with ``Z`` or an offset as UTC, one without as it is; null for other text."""
    zoned = F.try_to_timestamp(F.when(F.rlike(text, F.lit(r"(?i)(Z|[+-]\d\d:?\d\d)$")), text))
    return F.coalesce(F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz"), text.try_cast("timestamp_ntz"))


def with_locator(record: Column, artifact: Column, root: Column, index: Column) -> Column:
    """A record's JSON text with where it comes from: objects get a ``_locator``, other values are wrapped as ``value``."""
    place = F.to_json(F.struct(artifact.alias("artifact_id"), root.alias("root_path"), index.alias("index")))
    body = F.btrim(record, F.lit(" \t\r\n"))
    inner = F.regexp_replace(body, r"^\{\s*", "")
    return F.when(F.startswith(body, F.lit("{")), F.concat(F.lit('{"_locator":'), place, F.when(F.startswith(inner, F.lit("}")), F.lit("")).otherwise(","), inner)).otherwise(F.concat(F.lit('{"_locator":'), place, F.lit(',"value":'), body, F.lit("}")))


def artifact_ref(value: Column) -> Column:
    """struct(artifact_id, path) of a reference ``art_<32 hex digits>`` with an optional ``:$path``; null for other text."""
    pattern = r"^(art_[0-9a-f]{32})(?::(\$.*))?$"
    return F.when(F.rlike(value, F.lit(pattern)), F.struct(F.regexp_extract(value, pattern, 1).alias("artifact_id"), F.nullif(F.regexp_extract(value, pattern, 2), F.lit("")).alias("path")))


def without_reserved(args: Column, reserved: str = "_gateway_") -> Column:
    """A map of arguments without those whose names begin with ``reserved``."""
    return F.map_filter(args, lambda k, v: ~F.startswith(k, F.lit(reserved)))


def placeholder_cursor(c: Column) -> Column:
    """Whether a cursor value is one that callers write when they have none."""
    return F.lower(F.trim(c)).isin("", "null", "none", "undefined", "string", "<cursor>", "cursor", "next_cursor", "...")


def visible_scalar(kind: Column, text: Column) -> Column:
    """Whether a scalar holds something: no null, no blank string."""
    return kind.isin("number", "boolean") | ((kind == "string") & (F.trim(text) != ""))


def coerced_like(value: Column, kind: Column) -> Column:
    """A query value as JSON text of the type of an example; as a string if it does not fit."""
    number = F.when(F.rlike(value, F.lit("^-?\\d+(\\.\\d+)?$")), value)
    flag = F.when(F.lower(value).isin("true", "false"), F.lower(value))
    return F.coalesce(F.when(kind == "number", number), F.when(kind == "boolean", flag), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')))
