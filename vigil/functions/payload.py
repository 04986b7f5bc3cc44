"""Nested error-event payloads: frames, culprit, crash location, search text, tags."""

from __future__ import annotations

import re
from string import Formatter

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .text import basename, ellipsize, let, non_empty, strip_nul, url_host, url_path, url_scheme

# Fixed values.
NATIVE_PLATFORMS = ("objc", "cocoa", "native")
SCRIPT_PLATFORMS = ("javascript", "node")
UNUSABLE_FUNCTIONS = ("<redacted>", "<unknown>")
UNKNOWN_MODULE = "<unknown module>"
MODULE_NOISE = (
    r"(?i)^(?:/|(?:(?:java)?scripts?|js|build|static|node_modules|bower_components|[_\.~].*?"
    r"|v?(?:\d+\.)*\d+|[a-f0-9]{7,8}|[a-f0-9]{32}|[a-f0-9]{40})/)+|(?:[-\.][a-f0-9]{7,}$)"
)

FRAME = (
    "struct<filename:string,function:string,module:string,lineno:int,colno:int,abs_path:string,"
    "context_line:string,pre_context:array<string>,post_context:array<string>,in_app:boolean,"
    "platform:string,vars:map<string,string>>"
)
STACKTRACE = f"struct<frames:array<{FRAME}>>"
EXCEPTION = (
    "struct<type:string,value:string,module:string,thread_id:string,"
    f"mechanism:struct<type:string,handled:boolean,synthetic:boolean>,stacktrace:{STACKTRACE}>"
)
THREAD = f"struct<id:string,current:boolean,crashed:boolean,stacktrace:{STACKTRACE}>"
EVENT = (
    "struct<event_id:string,timestamp:string,platform:string,level:string,transaction:string,message:string,"
    "logentry:struct<formatted:string,message:string,params:array<string>>,"
    "release:string,environment:string,server_name:string,fingerprint:array<string>,"
    f"exception:struct<values:array<{EXCEPTION}>>,threads:struct<values:array<{THREAD}>>,"
    "request:struct<url:string,method:string,headers:array<array<string>>,query_string:string>,"
    "user:struct<id:string,email:string,username:string>,"
    "contexts:struct<browser:struct<name:string,version:string>,os:struct<name:string,version:string>,"
    "device:struct<family:string,model:string,brand:string>,trace:struct<op:string,status:string>>,"
    "tags:map<string,string>>"
)


def event_type() -> T.StructType:
    return T.DataType.fromDDL(EVENT)


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _newest_first(frames: Column) -> Column:
    return F.reverse(F.filter(frames, lambda f: f.isNotNull()))


# -- culprit and crash location ------------------------------------------------

def frame_culprit(frame: Column, platform: Column) -> Column:
    platform = F.coalesce(non_empty(frame["platform"]), platform, F.lit(""))
    function = F.coalesce(non_empty(frame["function"]), F.lit("?"))
    place = F.coalesce(non_empty(frame["module"]), non_empty(frame["filename"]), F.lit(""))
    return (
        F.when(platform.isin(*NATIVE_PLATFORMS), function)
        .when(place == "", F.lit(""))
        .when(platform.isin(*SCRIPT_PLATFORMS), F.concat(function, F.lit("("), place, F.lit(")")))
        .otherwise(F.concat(place, F.lit(" in "), function))
    )


def stacktrace_culprit(frames: Column, platform: Column) -> Column:
    """Newest in-app frame that has a name, else whatever the newest other frame gives."""
    newest = _newest_first(frames)
    named = F.transform(
        newest,
        lambda f: F.struct(
            F.coalesce(f["in_app"], F.lit(False)).alias("in_app"), frame_culprit(f, platform).alias("name")
        ),
    )

    def choose(names: Column) -> Column:
        own = _first(F.filter(names, lambda n: n["in_app"] & (n["name"] != "")))["name"]
        other = _first(F.filter(names, lambda n: ~n["in_app"]))["name"]
        return F.coalesce(own, other, F.lit(""))

    return let(named, choose)


def culprit(event: Column, limit: int | None = None) -> Column:
    """Where the event happened: transaction, else stacktrace, else request URL; ``limit`` is for display."""
    exceptions = F.filter(event["exception"]["values"], lambda e: e.isNotNull())
    last = F.try_element_at(exceptions, F.lit(-1))
    traced = F.filter(exceptions, lambda e: F.coalesce(F.size(e["stacktrace"]["frames"]), F.lit(0)) > 0)
    frames = F.try_element_at(traced, F.lit(-1))["stacktrace"]["frames"]
    from_trace = let(frames, lambda f: F.when(f.isNotNull(), stacktrace_culprit(f, event["platform"])))
    synthetic = F.coalesce(last["mechanism"]["synthetic"], F.lit(False))
    derived = F.when(synthetic, F.lit("")).otherwise(
        F.coalesce(let(from_trace, non_empty), event["request"]["url"], F.lit(""))
    )
    return let(F.coalesce(non_empty(event["transaction"]), derived), lambda c: ellipsize(c, limit))


def crash_frame(event: Column) -> Column:
    """Newest in-app frame with a real function, else the newest frame with one."""
    last = F.try_element_at(event["exception"]["values"], F.lit(-1))
    threads = event["threads"]["values"]
    only_thread = F.when(F.size(threads) == 1, _first(threads)["stacktrace"]["frames"])
    own = last["stacktrace"]["frames"]
    frames = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(only_thread)
    usable = F.filter(
        _newest_first(frames), lambda f: f["function"].isNotNull() & ~f["function"].isin(*UNUSABLE_FUNCTIONS)
    )
    return let(usable, lambda u: F.coalesce(_first(F.filter(u, lambda f: F.coalesce(f["in_app"], F.lit(False)))), _first(u)))


def crash_location(event: Column) -> tuple[Column, Column]:
    frame = crash_frame(event)
    return let(frame, lambda f: F.coalesce(non_empty(f["filename"]), f["abs_path"])), frame["function"]


# -- normalisation ---------------------------------------------------------------

def hydrate_exceptions(exceptions: Column, threads: Column) -> Column:
    """Give an exception without stacktrace the one of its thread, else of the current thread."""
    def fill(e: Column) -> Column:
        same = _first(F.filter(threads, lambda t: t["id"] == e["thread_id"]))
        current = _first(F.filter(threads, lambda t: F.coalesce(t["current"], F.lit(False))))
        chosen = F.when(same.isNotNull(), same["stacktrace"]).otherwise(current["stacktrace"])
        return e.withField("stacktrace", F.coalesce(e["stacktrace"], chosen))

    return F.when(F.coalesce(F.size(threads), F.lit(0)) > 0, F.transform(exceptions, fill)).otherwise(exceptions)


def normalize_frame_files(frames: Column) -> Column:
    """Default ``abs_path`` to the filename, and keep only the path of URL filenames."""
    def fix(f: Column) -> Column:
        name = f["filename"]
        is_url = name.rlike("^(file:|http:|https:|applewebdata:)")
        return f.withField(
            "abs_path", F.coalesce(non_empty(f["abs_path"]), non_empty(name), f["abs_path"])
        ).withField("filename", F.when(is_url, url_path(name)).otherwise(name))

    return F.transform(frames, fix)


def shorten_variables(variables: Column, longest: int | None = None) -> Column:
    """Frame variables; one above ``longest`` characters is replaced by a note of its size."""
    if longest is None:
        return variables
    return F.transform_values(
        variables,
        lambda k, v: F.when(
            F.length(v) > longest,
            F.concat(F.lit("[Truncated: "), F.length(v).cast("string"), F.lit(" bytes]")),
        ).otherwise(v),
    )


def context_lines(lineno: Column, line: Column, before: Column, after: Column) -> Column:
    """``[[number, text], ...]`` around a source line."""
    empty = F.array().cast("array<string>")
    before, after = F.coalesce(before, empty), F.coalesce(after, empty)
    lines = F.concat(before, F.array(line), after)
    first = lineno - F.size(before)
    numbered = F.transform(lines, lambda text, i: F.struct((first + i).alias("number"), text.alias("text")))
    nothing = lineno.isNull() | (line.isNull() & (F.size(before) == 0) & (F.size(after) == 0))
    return F.when(nothing, F.array().cast("array<struct<number:int,text:string>>")).otherwise(numbered)


def values_list(raw: Column, element: str) -> Column:
    """A JSON field given as a list or as ``{"values": [...]}`` to one array; empty is null."""
    listed = F.from_json(raw, f"array<{element}>")
    wrapped = F.from_json(raw, f"struct<values:array<{element}>>")["values"]
    found = F.when(F.ltrim(raw).startswith("["), listed).otherwise(wrapped)
    return F.when(F.size(found) > 0, found)


def nested(document: Column, path: list[str | int], default: str | None = None) -> Column:
    """A value of a JSON document by keys and list positions; ``default`` where the path ends early."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.coalesce(F.get_json_object(document, f"${steps}"), F.lit(default))


def usable_exceptions(exceptions: Column) -> Column:
    return F.filter(exceptions, lambda e: e.isNotNull() & (e["type"].isNotNull() | e["value"].isNotNull()))


def tags_map(raw: Column) -> Column:
    """Tags given as ``{k: v}`` or ``[[k, v], ...]`` to a map; null keys are dropped."""
    pairs = F.filter(F.from_json(raw, "array<array<string>>"), lambda p: (F.size(p) == 2) & p[0].isNotNull())
    listed = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].alias("k"), p[1].alias("v"))))
    return F.when(F.ltrim(raw).startswith("["), listed).otherwise(F.from_json(raw, "map<string,string>"))


def json_map(raw: Column) -> Column:
    """A JSON column as a map; bad or missing text gives an empty one."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_list(raw: Column) -> Column:
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def query_pairs(raw: Column) -> Column:
    """Raw query string to sorted ``{k, v}`` pairs; blank values are dropped."""
    def decode(text: Column) -> Column:
        return F.coalesce(F.try_url_decode(text), text)

    parts = F.filter(F.split(raw, "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
            decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    return F.array_sort(pairs)


def header_pairs(headers: Column) -> Column:
    """Header map to sorted pairs, without empty cookies; of a listed value the first counts."""
    def single(value: Column) -> Column:
        return F.when(value.startswith("["), F.coalesce(F.get_json_object(value, "$[0]"), value)).otherwise(value)

    entries = F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("k"), single(e["value"]).alias("v")))
    return F.array_sort(F.filter(entries, lambda e: ~((e["k"] == "Cookie") & (e["v"] == ""))))


def script_module(url: Column) -> Column:
    """A module name for a script URL: its path without extension, hashes and common folders."""
    path = F.regexp_replace(url_path(url), r"([^/.][^/]*)\.[^./]*$", "$1")
    path = F.regexp_replace(path, r"\.min$", "")

    def name(p: Column) -> Column:
        tokens = F.split(p, "/")
        sha_at = F.array_position(F.transform(tokens, lambda t: t.rlike("(?i)^[a-f0-9]{32}")), F.lit(True))
        after_sha = F.array_join(F.slice(tokens, sha_at + 1, F.size(tokens)), "/")
        cleaned = F.coalesce(non_empty(F.regexp_replace(p, MODULE_NOISE, "")), F.lit(UNKNOWN_MODULE))
        return F.when(sha_at > 0, after_sha).otherwise(cleaned)

    return F.when(F.coalesce(url, F.lit("")) == "", F.lit(UNKNOWN_MODULE)).otherwise(let(path, name))


# -- tags and search text ----------------------------------------------------------

def event_tags(event: Column) -> Column:
    """SDK tags plus those derived from contexts, user and release; empty values dropped."""
    browser, user = event["contexts"]["browser"], event["user"]

    def entry(name: str, value: Column, when: Column | None = None) -> Column:
        value = value if when is None else F.when(when, value)
        return F.when(_filled(value), F.struct(F.lit(name).alias("k"), value.alias("v")))

    derived = F.array_compact(F.array(
        entry("browser.name", browser["name"]),
        entry("browser", F.concat_ws(" ", browser["name"], browser["version"]), browser.isNotNull()),
        entry("os.name", event["contexts"]["os"]["name"]),
        entry("device", event["contexts"]["device"]["model"]),
        entry("user.id", user["id"]),
        entry("user.email", user["email"]),
        entry("user.username", user["username"]),
        entry("environment", event["environment"]),
        entry("release", event["release"]),
        entry("server_name", event["server_name"]),
    ))
    own = F.coalesce(event["tags"], F.create_map().cast("map<string,string>"))
    return F.map_filter(F.map_concat(own, F.map_from_entries(derived)), lambda k, v: _filled(v))


def search_text(title: Column, transaction: Column, event: Column, *, frames: int | None = None, files: int | None = None, length: int | None = None) -> Column:
    """Sorted distinct parts (title, transaction, URL, file names) joined by spaces.

    ``frames`` takes the newest file names of each stacktrace only, ``files`` the first of all
    stacktraces, ``length`` cuts the text between two words.
    """
    url = event["request"]["url"]
    host = url_host(url)
    origin = F.when((url_scheme(url) != "") & (host != ""), F.concat(url_scheme(url), F.lit("://"), host)).otherwise(host)
    first = lambda names, n: names if n is None else F.slice(names, 1, n)
    per_trace = F.transform(
        F.coalesce(event["exception"]["values"], F.array().cast(f"array<{EXCEPTION}>")),
        lambda e: first(F.filter(F.transform(
            _newest_first(F.coalesce(e["stacktrace"]["frames"], F.array().cast(f"array<{FRAME}>"))), lambda f: basename(f["filename"])
        ), _filled), frames),
    )
    parts = F.concat(F.array(title, transaction, F.concat(origin, url_path(url))), first(F.flatten(per_trace), files))
    text = F.array_join(F.array_sort(F.array_distinct(F.filter(parts, _filled))), " ")
    if length is None:
        return strip_nul(text)

    def cut(whole: Column) -> Column:
        # Not inside a word; a text without any space is cut hard.
        at_space = F.regexp_replace(F.substring(whole, 1, length), r"(?s) [^ ]*$", "")
        return F.when(F.length(whole) > length, at_space).otherwise(whole)

    return strip_nul(let(text, cut))


def entries(event: Column) -> Column:
    """Types of the sections an event shows, in display order."""
    def present(name: str, cond: Column) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(name))

    message = event["logentry"].isNotNull() | _filled(event["message"])
    return F.array_compact(F.array(
        present("exception", F.size(event["exception"]["values"]) > 0), present("message", message),
        present("request", event["request"].isNotNull()),
    ))


def has_system_frames(event: Column) -> Column:
    """Whether any frame of any exception belongs to the application itself."""
    in_app = lambda f: F.coalesce(f["in_app"], F.lit(False))
    return F.coalesce(
        F.exists(event["exception"]["values"], lambda e: F.coalesce(F.exists(e["stacktrace"]["frames"], in_app), F.lit(False))), F.lit(False)
    )


_WIDE = re.compile(r"\d{4,}|\*")


def interpolate(template: str | None, params, limit: int | None = None) -> str | None:
    """Best-effort ``%`` or ``{}`` formatting of one message; the template on failure.

    Fields are plain names: one that reaches into its value, or asks for a width of thousands,
    leaves the template as it is.
    """
    if template is None or params is None or not len(params):
        return template
    try:
        if isinstance(params, dict):
            fields = [(name, spec or "") for _, name, spec, _ in Formatter().parse(template) if name is not None]
            if not all(name.isidentifier() and not _WIDE.search(spec) and "{" not in spec for name, spec in fields):
                return template
            out = template.format_map(params)
        else:
            if any(_WIDE.search(found) for found in re.findall(r"%[^A-Za-z%]*", template)):
                return template
            out = template % tuple(int(p) if isinstance(p, str) and p.isdigit() else p for p in params)
        return out if limit is None else out[:limit]
    except (TypeError, ValueError, KeyError, IndexError, AttributeError, OverflowError):
        return template


@F.pandas_udf(T.StringType())
def interpolate_positional(template: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([interpolate(t, None if p is None else list(p)) for t, p in zip(template, params)])


@F.pandas_udf(T.StringType())
def interpolate_named(template: pd.Series, params: pd.Series) -> pd.Series:
    return pd.Series([interpolate(t, None if p is None else dict(p)) for t, p in zip(template, params)])


def anonymize_ip(ip: Column) -> Column:
    """Zero the last IPv4 octet or the last 80 IPv6 bits."""
    halves = F.split(ip, "::")
    left = F.filter(F.split(halves[0], ":"), lambda g: g != "")
    right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda g: g != "")
    gap = F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right))
    groups = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    v6 = F.concat(F.array_join(F.slice(groups, 1, 3), ":"), F.lit("::"))
    return F.when(ip.contains(":"), v6).otherwise(F.regexp_replace(ip, r"\.\d+$", ".0"))


def is_routable(ip: Column) -> Column:
    private = r"(?i)^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|0\.|::1$|f[cd][0-9a-f]{2}:|fe80:)"
    return ip.isNotNull() & ~ip.rlike(private)


def client_ip(ip: Column, project_flag: Column, org_flag: Column) -> Column:
    """Routable addresses only; masked when the project or its organisation asks for it."""
    masked = F.when(project_flag | org_flag, anonymize_ip(ip)).otherwise(ip)
    return F.when(is_routable(ip), masked)
