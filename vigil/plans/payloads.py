"""Queries over nested error payloads and over text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as K, levels as V, payload as P, text as X
from ..functions.timeparam import moment
from ..sources import telemetry_json as J
from .registry import NOW, Tables, query

# Error events: an order is an event, its line items are the frames of two exceptions.
FRAMES = """SELECT l_orderkey AS event_key, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 2 END AS ex,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, l_shipdate) AS pos,
 CASE l_partkey % 4 WHEN 0 THEN 'https://cdn.example.com/js/app' || CAST(l_partkey % 50 AS STRING) || '.min.js?v=1' WHEN 1 THEN '/srv/app/mod' || CAST(l_suppkey % 10 AS STRING) || '.py'
  WHEN 2 THEN 'lib/x' || CAST(l_partkey % 9 AS STRING) || '.rb' END AS filename,
 CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '<unknown>' ELSE 'fn_' || CAST(l_suppkey % 13 AS STRING) END AS function,
 CASE WHEN l_partkey % 5 = 0 THEN 'app.m' || CAST(l_partkey % 17 AS STRING) END AS module, l_returnflag = 'A' AS in_app, CAST(l_quantity AS INT) AS lineno
FROM {lineitem}"""
EVENTS = """SELECT o_orderkey AS event_key, CASE o_custkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'native' ELSE 'other' END AS platform,
 CASE WHEN o_orderkey % 5 = 0 THEN '/t/' || CAST(o_custkey AS STRING) END AS transaction,
 CASE WHEN o_orderkey % 3 = 0 THEN 'HTTPS://shop.example.com/orders/' || CAST(o_orderkey AS STRING) || '?q=1' END AS url,
 o_orderkey % 11 = 0 AS synthetic, o_orderkey % 2 = 0 AS threaded, 'E' || o_orderstatus AS exc_type, 'Failed ' || o_orderpriority AS exc_value, o_custkey AS user_key
FROM {orders}"""
SQL_TABLES = f"f AS ({FRAMES.replace('{lineitem}', 'lineitem')}), e AS ({EVENTS.replace('{orders}', 'orders')})"


def error_events(t: Tables):
    """(event_key, event): JSON payloads built from the tables and parsed as on arrival."""
    frame = F.struct("pos", "filename", "function", "module", "in_app", "lineno")
    traces = t.sql(FRAMES).groupBy("event_key").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("ex") == n, frame))).alias(f"frames{n}") for n in (1, 2)
    ])
    rows = t.sql(EVENTS).join(traces, "event_key", "left")

    def trace(n):
        return F.when(F.size(f"frames{n}") > 0, F.struct(F.col(f"frames{n}").alias("frames")))

    first = F.struct(F.lit("Inner").alias("type"), F.lit("cause").alias("value"), trace(1).alias("stacktrace"))
    second = F.struct(
        F.col("exc_type").alias("type"), F.col("exc_value").alias("value"), F.lit("1").alias("thread_id"),
        F.struct(F.col("synthetic")).alias("mechanism"), trace(2).alias("stacktrace"),
    )
    threads = F.array(F.struct(F.lit("1").alias("id"), F.lit(True).alias("current"), trace(1).alias("stacktrace")))
    doc = F.concat(
        F.lit('{"platform":"'), F.col("platform"), F.lit('"'),
        F.when(F.col("transaction").isNotNull(), F.concat(F.lit(',"transaction":"'), F.col("transaction"), F.lit('"'))).otherwise(F.lit("")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit(',"request":{"url":"'), F.col("url"), F.lit('"}'))).otherwise(F.lit("")),
        F.lit(',"exception":{"values":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]}"),
        F.when(F.col("threaded"), F.concat(F.lit(',"threads":{"values":'), F.to_json(threads), F.lit("}"))).otherwise(F.lit("")),
        F.lit("}"),
    )
    return rows.select("event_key", F.from_json(doc, P.event_type()).alias("event"))


NAMED = """last_ex AS (SELECT event_key, max(ex) AS ex FROM f GROUP BY event_key),
named AS (SELECT f.event_key, f.pos, f.in_app, CASE WHEN e.platform = 'native' THEN coalesce(f.function, '?') WHEN coalesce(f.module, f.filename) IS NULL THEN ''
 WHEN e.platform = 'javascript' THEN coalesce(f.function, '?') || '(' || coalesce(f.module, f.filename) || ')' ELSE coalesce(f.module, f.filename) || ' in ' || coalesce(f.function, '?') END AS name
 FROM f JOIN last_ex l ON l.event_key = f.event_key AND l.ex = f.ex JOIN e ON e.event_key = f.event_key),
picked AS (SELECT event_key, arg_max(name, pos) FILTER (WHERE in_app AND name <> '') AS own, arg_max(name, pos) FILTER (WHERE NOT in_app) AS other FROM named GROUP BY event_key)"""


@query("f17_culprit", f"""
WITH {SQL_TABLES}, {NAMED}
SELECT e.event_key, CASE WHEN transaction IS NOT NULL THEN transaction WHEN synthetic THEN '' ELSE coalesce(nullif(coalesce(own, other, ''), ''), url, '') END AS culprit
FROM e LEFT JOIN picked p ON p.event_key = e.event_key""")
def culprits(t: Tables):
    return error_events(t).select("event_key", P.culprit(F.col("event")).alias("culprit"))


@query("f18_crash_location", f"""
WITH {SQL_TABLES},
src AS (SELECT event_key, max(ex) AS top FROM f GROUP BY event_key),
used AS (SELECT f.* FROM f JOIN src s ON s.event_key = f.event_key JOIN e ON e.event_key = f.event_key
 WHERE function IS NOT NULL AND function <> '<unknown>' AND ((s.top = 2 AND f.ex = 2) OR (s.top = 1 AND e.threaded))),
best AS (SELECT event_key, coalesce(arg_max(pos, pos) FILTER (WHERE in_app), max(pos)) AS pos FROM used GROUP BY event_key)
SELECT e.event_key, u.filename, u.function FROM e LEFT JOIN best b ON b.event_key = e.event_key LEFT JOIN used u ON u.event_key = b.event_key AND u.pos = b.pos""")
def crash_locations(t: Tables):
    filename, function = P.crash_location(F.col("event"))
    return error_events(t).select("event_key", filename.alias("filename"), function.alias("function"))


@query("j17_hydrate_stacktraces", f"""
WITH {SQL_TABLES}, n AS (SELECT event_key, count(*) FILTER (WHERE ex = 1) AS a, count(*) FILTER (WHERE ex = 2) AS b FROM f GROUP BY event_key)
SELECT e.event_key, CAST(coalesce(a, 0) AS INT) AS first_frames, CAST(CASE WHEN coalesce(b, 0) = 0 AND threaded THEN coalesce(a, 0) ELSE coalesce(b, 0) END AS INT) AS second_frames
FROM e LEFT JOIN n ON n.event_key = e.event_key""")
def hydrate_stacktraces(t: Tables):
    exceptions = P.hydrate_exceptions(F.col("event.exception.values"), F.col("event.threads.values"))
    sizes = F.transform(exceptions, lambda x: F.coalesce(F.size(x["stacktrace"]["frames"]), F.lit(0)))
    return error_events(t).select("event_key", sizes[0].alias("first_frames"), sizes[1].alias("second_frames"))


@query("f12_search_text", f"""
WITH {SQL_TABLES},
b AS (SELECT event_key, ex, pos, split_part(filename, '/', -1) AS name FROM f WHERE filename IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_key, ex ORDER BY pos DESC) AS n FROM b),
parts AS (SELECT event_key, exc_type || ': ' || exc_value AS p FROM e UNION SELECT event_key, transaction FROM e WHERE transaction IS NOT NULL
 UNION SELECT event_key, 'https://shop.example.com/orders/' || CAST(event_key AS VARCHAR) FROM e WHERE url IS NOT NULL UNION SELECT event_key, name FROM r)
SELECT event_key, string_agg(p, ' ' ORDER BY p) AS words FROM parts GROUP BY event_key""")
def search_texts(t: Tables):
    last = F.element_at("event.exception.values", -1)
    title = X.error_title(last["type"], last["value"], F.lit(None).cast("string"), F.lit(False))
    return error_events(t).select("event_key", P.search_text(title, F.col("event.transaction"), F.col("event")).alias("words"))


@query("f39_frame_files", f"""
WITH {SQL_TABLES}
SELECT event_key, CAST(pos AS INT) AS pos, CASE WHEN filename LIKE 'https:%' THEN regexp_extract(filename, '^https://[^/]*([^?#]*)', 1) ELSE filename END AS filename, filename AS abs_path FROM f""")
def frame_files(t: Tables):
    frame = F.struct(F.col("filename"), F.lit(None).cast("string").alias("abs_path"))
    fixed = P.normalize_frame_files(F.array(frame))[0]
    return t.sql(FRAMES).select("event_key", "pos", fixed["filename"].alias("filename"), fixed["abs_path"].alias("abs_path"))


@query("f33_script_module", """
WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x.io/static/js/v1.2.3/' || split_part(url, '/', 3) || '/bundle.min.js?x=1' WHEN 1 THEN 'https://x.io/a/' || md5(url) || '/lib/main.js'
 WHEN 2 THEN url || '/scripts/x.y.js' WHEN 3 THEN '' ELSE url END AS u FROM pages),
p AS (SELECT page_id, u, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?', ''), '(?s)[?#].*', ''), '([^/.][^/]*)\\.[^./]*$', '\\1'), '\\.min$', '') AS path FROM u),
s AS (SELECT *, list_position(list_transform(string_split(path, '/'), lambda x: regexp_matches(x, '^[a-f0-9]{32}')), TRUE) AS sha FROM p)
SELECT page_id, CASE WHEN u = '' THEN '<unknown module>' WHEN coalesce(sha, 0) > 0 THEN array_to_string(string_split(path, '/')[sha + 1:], '/')
 ELSE coalesce(nullif(regexp_replace(path, '(?i)^(?:/|(?:(?:java)?scripts?|js|build|static|node_modules|bower_components|[_\\.~].*?|v?(?:\\d+\\.)*\\d+|[a-f0-9]{7,8}|[a-f0-9]{32}|[a-f0-9]{40})/)+|(?:[-\\.][a-f0-9]{7,}$)', '', 'g'), ''), '<unknown module>') END AS module FROM s""")
def script_modules(t: Tables):
    url = F.expr("""CASE page_id % 5 WHEN 0 THEN 'https://x.io/static/js/v1.2.3/' || split_part(url, '/', 3) || '/bundle.min.js?x=1' WHEN 1 THEN 'https://x.io/a/' || md5(url) || '/lib/main.js'
 WHEN 2 THEN url || '/scripts/x.y.js' WHEN 3 THEN '' ELSE url END""")
    return t("pages").select("page_id", P.script_module(url).alias("module"))


@query("f40_large_variables", """
SELECT doc_id, CASE WHEN length(text) > 16384 THEN '[Truncated: ' || CAST(length(text) AS VARCHAR) || ' bytes]' ELSE md5(text) END AS value FROM documents""")
def large_variables(t: Tables):
    short = P.shorten_variables(F.create_map(F.lit("v"), F.col("text")), longest=16 * 1024)["v"]
    return t("documents").select("doc_id", F.when(short.startswith("[Truncated: "), short).otherwise(F.md5(short)).alias("value"))


@query("f41_shapes", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN event_type ELSE event_type || ',' || 'T' END AS exceptions, CASE event_id % 2 WHEN 0 THEN 'a=' || CAST(user_id AS VARCHAR) || ';b=2' ELSE 'a=' || CAST(user_id AS VARCHAR) || ';b=2' END AS tags FROM events""")
def shapes(t: Tables):
    kind = F.col("event_type")
    one = F.concat(F.lit('{"type":"'), kind, F.lit('"}'))
    many = F.concat(F.lit("["), one, F.lit(',{"module":"m"},{"type":"T","value":"v"}]'))
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.lit('{"values":[]}')).when(F.col("event_id") % 4 == 1, many)
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"values":'), many, F.lit("}"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    )
    user = F.col("user_id").cast("string")
    tags = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"a":"'), user, F.lit('","b":2}'))).otherwise(
        F.concat(F.lit('[["a","'), user, F.lit('"],[null,"x"],["b","2"]]'))
    )
    found = P.usable_exceptions(P.values_list(raw, P.EXCEPTION))
    pairs = F.transform(F.array_sort(F.map_entries(P.tags_map(tags))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t("events").select(
        "event_id", F.array_join(F.transform(found, lambda x: x["type"]), ",").alias("exceptions"), F.array_join(pairs, ";").alias("tags")
    )


@query("f42_field_errors", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts ELSE <<now>> END AS timestamp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_key,
 CASE WHEN event_id % 15 = 0 THEN 'timestamp,user' WHEN event_id % 3 = 0 THEN 'timestamp' WHEN event_id % 5 = 0 THEN 'user' ELSE '' END AS errors FROM events""")
def field_errors(t: Tables):
    at = F.when(F.col("event_id") % 3 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    user = F.when(F.col("event_id") % 5 == 0, F.lit('"oops"')).otherwise(F.concat(F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('"}')))
    raw = F.concat(F.lit('{"timestamp":"'), at, F.lit('","user":'), user, F.lit("}"))
    values, errors = J.capture_errors(raw, {"timestamp": "timestamp_ntz", "user": "struct<id:string,email:string>"})
    return t("events").select(
        "event_id", F.coalesce(values["timestamp"], moment(NOW)).alias("timestamp"), values["user"]["id"].alias("user_key"),
        F.array_join(F.transform(errors, lambda e: e["name"]), ",").alias("errors"),
    )


@query("f43_context_lines", """
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
y AS (SELECT doc_id, lines, len(lines) AS n, CAST(len(lines) + 1 AS BIGINT) // 2 AS mid FROM x)
SELECT doc_id, md5(array_to_string(list_transform(range(1, n + 1), lambda i: CAST(100 + i - mid AS VARCHAR) || ':' || lines[i]), chr(10))) AS context FROM y""")
def context_lines(t: Tables):
    lines = F.split("text", "\n")
    mid = F.expr("(size(lines) + 1) div 2").cast("int")
    context = P.context_lines(
        F.lit(100), F.expr("lines[mid - 1]"), F.expr("slice(lines, 1, mid - 1)"), F.expr("slice(lines, mid + 1, size(lines))")
    )
    shown = F.transform(context, lambda c: F.concat(c["number"].cast("string"), F.lit(":"), c["text"]))
    return t("documents").withColumn("lines", lines).withColumn("mid", mid).select("doc_id", F.md5(F.array_join(shown, "\n")).alias("context"))


@query("f44_reports", """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ev' || CAST(conv_id AS VARCHAR) END AS event_ref, substr(text, 1, 128) AS name,
 CASE WHEN turn % 2 = 0 THEN substr(repeat(role, 60), 1, 254) ELSE '' END AS email, md5(text) AS comments FROM conversations""")
def reports(t: Tables):
    new = F.to_json(F.struct(F.struct(F.struct(
        F.col("text").alias("message"), F.col("text").alias("name"), F.repeat("role", 60).alias("contact_email"),
        F.concat(F.lit("ev"), F.col("conv_id").cast("string")).alias("associated_event_id"),
    ).alias("feedback")).alias("contexts")))
    old = F.to_json(F.struct(F.col("text").alias("name"), F.col("text").alias("comments")))
    row = J.read_reports(F.when(F.col("turn") % 2 == 0, new).otherwise(old))
    out = t("conversations").withColumn("r", row)
    return out.select("conv_id", "turn", F.col("r.event_id").alias("event_ref"), "r.name", "r.email", F.md5("r.comments").alias("comments"))


# -- titles, ids, small expressions ------------------------------------------------------

FIRST = "regexp_extract({0}, '^[^\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*', 0)"


@query("f14_error_title", f"""
WITH x AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE source END AS kind, CASE WHEN doc_id % 7 = 1 THEN '' ELSE text END AS v, doc_id % 10 = 3 AS synthetic FROM documents),
y AS (SELECT *, coalesce(kind, 'Error') AS k, {FIRST.format('v')} AS line FROM x),
z AS (SELECT doc_id, CASE WHEN synthetic THEN CASE WHEN doc_id % 20 = 3 THEN 'main' ELSE '<unknown>' END WHEN v = '' THEN k ELSE k || ': ' || line END AS title FROM y)
SELECT doc_id, title FROM z""")
def error_titles(t: Tables):
    key = F.col("doc_id")
    kind = F.when(key % 6 != 1, F.col("source"))
    value = F.when(key % 7 == 1, F.lit("")).otherwise(F.col("text"))
    function = F.when(key % 20 == 3, F.lit("main"))
    return t("documents").select("doc_id", X.error_title(kind, value, function, key % 10 == 3).alias("title"))


@query("f15_message_title", f"""
WITH x AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '' ELSE '' END AS m FROM conversations),
y AS (SELECT *, {FIRST.format("regexp_replace(regexp_replace(m, '^[\\s]+', ''), '[\\s]+$', '')")} AS line FROM x)
SELECT conv_id, turn, CASE WHEN m = '' THEN '<untitled>' ELSE m END AS title, CASE WHEN m = '' THEN '<unlabeled event>' ELSE line END AS metadata_title FROM y""")
def message_titles(t: Tables):
    n = F.col("turn") % 4
    formatted, message = F.when(n == 0, F.col("text")).otherwise(F.lit("")), F.when(n == 1, F.col("text"))
    return t("conversations").select(
        "conv_id", "turn", X.message_title(formatted, message).alias("title"), X.default_title(formatted, message).alias("metadata_title")
    )


@query("f16_csp_title", """
SELECT page_id, 'Blocked ''' || replace(CASE page_id % 3 WHEN 0 THEN 'script-src-elem' WHEN 1 THEN 'img-src' ELSE 'base-uri' END, '-src', '') || ''' from ''' ||
 CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 5 = 1 THEN 'cdn.example.com:8443' ELSE regexp_extract(url, '^https?://([^/?#]*)', 1) END || '''' AS title FROM pages""")
def csp_titles(t: Tables):
    key = F.col("page_id")
    directive = F.when(key % 3 == 0, "script-src-elem").when(key % 3 == 1, "img-src").otherwise("base-uri")
    blocked = F.when(key % 5 == 0, F.lit("inline")).when(key % 5 == 1, F.lit("//cdn.example.com:8443/a.js?x#y")).otherwise(F.col("url"))
    return t("pages").select("page_id", X.csp_title(directive, blocked).alias("title"))


@query("f19_event_tags", """
SELECT event_id, 'browser=Fx 12;browser.name=Fx;' || CASE WHEN event_id % 2 = 0 THEN 'device=P9;' ELSE '' END || 'environment=prod;' || 'own=' || event_type || ';release=r' || CAST(user_id AS VARCHAR) || ';user.id=' || CAST(user_id AS VARCHAR) AS tags FROM events""")
def event_tags(t: Tables):
    doc = F.concat(
        F.lit('{"environment":"prod","server_name":"","release":"r'), F.col("user_id").cast("string"),
        F.lit('","user":{"id":"'), F.col("user_id").cast("string"), F.lit('","email":""},"contexts":{"browser":{"name":"Fx","version":"12"}'),
        F.when(F.col("event_id") % 2 == 0, F.lit(',"device":{"model":"P9"}')).otherwise(F.lit("")),
        F.lit('},"tags":{"own":"'), F.col("event_type"), F.lit('","environment":"sdk","empty":"","none":null}}'),
    )
    tags = P.event_tags(F.col("event"))
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t("events").withColumn("event", F.from_json(doc, P.event_type())).select("event_id", F.array_join(pairs, ";").alias("tags"))


@query("f20_strip_nul", """
SELECT event_id, event_type || 'x' AS text, '{"k":"' || event_type || '\\\\u0000z"}' AS json, event_type AS value FROM events""")
def strip_nul(t: Tables):
    """A NUL goes; an escaped backslash followed by ``u0000`` stays."""
    kind = F.col("event_type")
    raw = F.concat(F.lit('{"k\\u0000":"\\u0000'), kind, F.lit('\\\\u0000z\\u0000"}'))
    tags = X.strip_nul_map(F.create_map(F.lit("a\u0000"), F.concat(kind, F.lit("\u0000"))))
    return t("events").select(
        "event_id", X.strip_nul(F.concat(kind, F.lit("\u0000x"))).alias("text"), X.strip_nul_json(raw).alias("json"), tags["a"].alias("value")
    )


@query("f21_truncate", """
SELECT doc_id, substr(text, 1, 255) AS tag, md5(substr(text, 1, 1024)) AS transaction, substr(text, 1, 32) AS span_id, CAST(length(substr(text, 1, 500)) AS INT) AS n FROM documents""")
def truncations(t: Tables):
    text = F.col("text")
    return t("documents").select(
        "doc_id", X.clean_tag(text, 255).alias("tag"), F.md5(X.truncate(text, 1024)).alias("transaction"), X.truncate(text, 32).alias("span_id"),
        F.length(X.truncate(text, 500)).alias("n"),
    )


DIGITS = "'0123456789ABCDEFGHIJKLMNOPQRSTUV'"


@query("f29_short_id", f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'SHOP-' || CASE WHEN n >= 32768 THEN substr({DIGITS}, CAST(n // 32768 % 32 AS INT) + 1, 1) ELSE '' END ||
 CASE WHEN n >= 1024 THEN substr({DIGITS}, CAST(n // 1024 % 32 AS INT) + 1, 1) ELSE '' END || CASE WHEN n >= 32 THEN substr({DIGITS}, CAST(n // 32 % 32 AS INT) + 1, 1) ELSE '' END || substr({DIGITS}, CAST(n % 32 AS INT) + 1, 1) END AS short_id
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders) x""")
def short_ids(t: Tables):
    number = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice"))
    return t("orders").select("o_orderkey", X.short_id(F.lit("shop"), number).alias("short_id"))


@query("f30_interpolate", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Order %d of %s' ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR) END AS positional,
 CASE WHEN o_orderstatus = 'P' THEN 'Order {n} of {who}' ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) || ' of ' || CAST(o_custkey AS VARCHAR) END AS named FROM orders""")
def interpolations(t: Tables):
    """Mismatched parameters leave the template as it is."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    odd = F.col("o_orderstatus") == "P"
    params = F.when(odd, F.array(F.lit("text"), who)).otherwise(F.array(key, who))
    named = F.when(odd, F.create_map(F.lit("n"), key)).otherwise(F.create_map(F.lit("n"), key, F.lit("who"), who))
    return t("orders").select(
        "o_orderkey", P.interpolate_positional(F.lit("Order %d of %s"), params).alias("positional"),
        P.interpolate_named(F.lit("Order {n} of {who}"), named).alias("named"),
    )


@query("f31_query_pairs", """
WITH q AS (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) || '&z=1%202&empty=&a=b+c&a=a' AS q FROM pages),
p AS (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM q)
SELECT page_id, string_agg(kv, ';' ORDER BY split_part(kv, '=', 1), split_part(kv, '=', 2)) AS pairs FROM (SELECT page_id, url_decode(replace(kv, '+', ' ')) AS kv FROM p WHERE regexp_matches(kv, '^[^=]*=.')) x GROUP BY page_id""")
def query_pairs(t: Tables):
    raw = F.concat(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&z=1%202&empty=&a=b+c&a=a"))
    shown = F.transform(P.query_pairs(raw), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    return t("pages").select("page_id", F.array_join(shown, ";").alias("pairs"))


@query("f31_header_pairs", """
SELECT event_id, 'Accept=' || event_type || CASE WHEN event_id % 2 = 0 THEN '' ELSE ';Cookie=x' END || ';Foo=bar;Host=h' AS pairs FROM events""")
def header_pairs(t: Tables):
    cookie = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.lit("x"))
    shown = F.transform(
        P.header_pairs(F.create_map(F.lit("Host"), F.lit("h"), F.lit("Cookie"), cookie, F.lit("Accept"), F.col("event_type"), F.lit("Foo"), F.lit('["bar","baz"]'))),
        lambda p: F.concat(p["k"], F.lit("="), p["v"]),
    )
    return t("events").select("event_id", F.array_join(shown, ";").alias("pairs"))


@query("f32_json_default", """
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS items FROM events""")
def json_default(t: Tables):
    n = F.col("event_id") % 3
    raw = F.when(n == 2, F.lit("{broken")).otherwise(F.col("props"))
    listed = F.when(n == 0, F.lit('["a","b"]')).when(n == 1, F.lit("oops"))
    parsed = P.json_map(raw)
    return t("events").select("event_id", F.try_element_at(parsed, F.lit("k")).alias("k"), F.size(parsed).alias("n"), F.size(P.json_list(listed)).alias("items"))


@query("f34_nested_get", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), 'none') AS found, 'none' AS missing, event_type AS last FROM events""")
def nested_get(t: Tables):
    items = F.array(F.lit("first"), F.col("event_type"))
    return t("events").select(
        "event_id", P.nested(F.col("props"), ["k"], "none").alias("found"),
        P.nested(F.col("props"), ["x", "y", 3], "none").alias("missing"), F.try_element_at(items, F.lit(-1)).alias("last"),
    )


@query("f36_public_view", """
SELECT event_id, replace(CASE WHEN event_id % 2 = 0 THEN <<uuid7(ts; event_id)>> ELSE md5(event_type) END, '-', '') AS public_id,
 CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'Title ' || event_type END AS message, date_trunc('milliseconds', ts) AS received FROM events""")
def public_view(t: Tables):
    uid = K.uuid7_from_timestamp(F.col("ts"), F.col("event_id"))
    client = F.when(F.col("event_id") % 2 != 0, F.md5("event_type"))
    message = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    return t("events").select(
        "event_id", X.event_public_id(client, uid).alias("public_id"),
        F.coalesce(message, F.concat(F.lit("Title "), "event_type")).alias("message"), K.uuid7_timestamp(uid).alias("received"),
    )


@query("f36_entries", f"""
WITH {SQL_TABLES}
SELECT e.event_key, 'exception' || CASE WHEN url IS NOT NULL THEN ',request' ELSE '' END AS entries, coalesce(bool_or(f.in_app), FALSE) AS has_system_frames
FROM e LEFT JOIN f ON f.event_key = e.event_key GROUP BY e.event_key, url""")
def event_entries(t: Tables):
    return error_events(t).select(
        "event_key", F.array_join(P.entries(F.col("event")), ",").alias("entries"), P.has_system_frames(F.col("event")).alias("has_system_frames")
    )


@query("f37_labels", """
SELECT issue_id, CASE level WHEN 2 THEN 'info' WHEN 3 THEN 'warning' WHEN 4 THEN 'error' END AS level_name, CASE level WHEN 2 THEN '#4b60b4' WHEN 3 THEN '#e9b949' ELSE '#e52b50' END AS colour,
 CASE status WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ignored' END AS status_name FROM issues""")
def labels(t: Tables):
    return t("issues").select(
        "issue_id", V.issue_level_label(F.col("level")).alias("level_name"), V.issue_colour(F.col("level")).alias("colour"),
        V.issue_status_label(F.col("status")).alias("status_name"),
    )


ADDRESS = "CASE event_id % 5 WHEN 0 THEN '10.1.2.' || CAST(user_id % 250 AS STRING) WHEN 1 THEN '2001:db8:' || CAST(user_id % 99 AS STRING) || '::1' WHEN 2 THEN '2001:db8:1:2:3:4:5:' || CAST(user_id % 99 AS STRING) ELSE '8.8.' || CAST(user_id % 250 AS STRING) || '.7' END"


@query("f38_client_ip", f"""
WITH x AS (SELECT event_id, {ADDRESS} AS ip, (user_id % 5) % 3 = 0 AS project_flag, user_id % 3 % 2 = 0 AS org_flag, user_id FROM events)
SELECT event_id, CASE WHEN ip LIKE '10.%' THEN NULL WHEN NOT (project_flag OR org_flag) THEN ip WHEN ip LIKE '%::1' THEN replace(ip, '::1', '::')
 WHEN ip LIKE '2001:%' THEN '2001:db8:1::' ELSE regexp_replace(ip, '\\.\\d+$', '.0') END AS ip FROM x""")
def client_ips(t: Tables):
    rows = t("events").select(
        "event_id", F.expr(ADDRESS).alias("ip"), (F.col("user_id") % 5).alias("project_id"), (F.col("user_id") % 3).alias("organization_id")
    )
    projects = t("projects").select("project_id", F.col("scrub_ip").alias("project_flag"))
    orgs = t("organizations").select("organization_id", F.col("scrub_ip").alias("org_flag"))
    joined = rows.join(projects, "project_id", "left").join(orgs, "organization_id", "left")
    return joined.select("event_id", P.client_ip(F.col("ip"), F.col("project_flag"), F.col("org_flag")).alias("ip"))


# -- JSON inputs -------------------------------------------------------------------------

@query("s15_json_envelopes", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN 'events' ELSE 'logs' END AS target, event_id % 13 = 0 AS broken,
 CASE WHEN event_id % 13 <> 0 THEN ts END AS received, CASE WHEN event_id % 13 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events""".replace(
    "CASE WHEN event_id % 4 = 3 THEN NULL", "CASE WHEN event_id % 13 = 0 OR event_id % 4 = 3 THEN NULL"))
def json_envelopes(t: Tables):
    """Poison lines end up in a table of their own; the others are routed by type."""
    kind = F.when(F.col("event_id") % 4 == 0, "event").when(F.col("event_id") % 4 == 3, "mystery").otherwise("log")
    doc = F.to_json(F.struct(
        kind.alias("type"), (F.col("user_id") % 5).cast("int").alias("project_id"), F.col("ts").cast("string").alias("received"), F.col("props").alias("payload")
    ))
    lines = t.spread("events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.substring(doc, 1, 25)).otherwise(doc).alias("value"))
    good, bad = J.read_envelopes(lines)
    kept = good.select("event_id", F.col("table").alias("target"), F.lit(False).alias("broken"), "received", F.get_json_object("payload", "$.k").alias("k"))
    gone = bad.select("event_id", F.lit(None).cast("string").alias("target"), F.lit(True).alias("broken"),
                      F.lit(None).cast("timestamp_ntz").alias("received"), F.lit(None).cast("string").alias("k"))
    return kept.unionByName(gone)


@query("s15_log_items", """
SELECT event_id, ts AS timestamp, event_type AS body, CAST(user_id AS VARCHAR) AS service FROM events""")
def log_items(t: Tables):
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    epoch = F.format_string("%d.%06d", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"), F.expr("unix_micros(cast(ts as timestamp)) % 1000000"))
    at = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), iso, F.lit('"'))).otherwise(epoch)
    doc = F.concat(
        F.lit('{"timestamp":'), at, F.lit(',"level":"info","body":"'), F.col("event_type"),
        F.lit('","attributes":{"service.name":{"value":"'), F.col("user_id").cast("string"), F.lit('","type":"string"},"n":{"value":5,"type":"integer"}}}'),
    )
    good, _ = J.read_log_items(t.spread("events").select("event_id", doc.alias("value")))
    return good.select("event_id", "timestamp", "body", F.col("attributes")["service.name"].alias("service"))


@query("s16_otlp_logs", """
SELECT event_id, date_trunc('milliseconds', ts) AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'custom' END AS level, event_type AS body, CAST(CASE WHEN event_id % 2 = 0 THEN 14 END AS INT) AS severity_number,
 'rec' AS who, CAST(user_id AS VARCHAR) AS n, '1' AS shared, NULL::VARCHAR AS sdk FROM events""")
def otlp_logs(t: Tables):
    """Both spellings; record attributes win, SDK attributes go, observed time fills in."""
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    shared = '{"key":"who","value":{"%s":"res"}},{"key":"shared","value":{"%s":"1"}},{"key":"telemetry.sdk.name","value":{"%s":"x"}}'
    snake = F.concat(
        F.lit('{"resource_logs":[{"resource":{"attributes":[' + shared.replace("%s", "string_value") + ']},"scope_logs":[{"log_records":[{"time_unix_nano":"'), millis,
        F.lit('000000","severity_number":14,"body":{"string_value":"'), F.col("event_type"),
        F.lit('"},"attributes":[{"key":"who","value":{"string_value":"rec"}},{"key":"n","value":{"int_value":'), F.col("user_id").cast("string"), F.lit("}}]}]}]}]}"),
    )
    camel = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[' + shared.replace("%s", "stringValue") + ']},"scopeLogs":[{"logRecords":[{"timeUnixNano":"0","observedTimeUnixNano":"'), millis,
        F.lit('000000","severityText":"CUSTOM","body":{"stringValue":"'), F.col("event_type"),
        F.lit('"},"attributes":[{"key":"who","value":{"stringValue":"rec"}},{"key":"n","value":{"intValue":"'), F.col("user_id").cast("string"), F.lit('"}}]}]}]}]}'),
    )
    lines = t.spread("events").select("event_id", F.when(F.col("event_id") % 2 == 0, snake).otherwise(camel).alias("value"))
    attrs = F.col("attributes")
    return J.read_otlp(lines).select(
        "event_id", "timestamp", "level", "body", "severity_number", attrs["who"].alias("who"), attrs["n"].alias("n"), attrs["shared"].alias("shared"),
        F.try_element_at(attrs, F.lit("telemetry.sdk.name")).alias("sdk"),
    )
