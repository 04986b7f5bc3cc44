"""Scrubbing queries over documents, conversations and event payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import pii
from .registry import Tables, query

EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
PEM = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
BLOCK = "chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'MIIabc' || chr(10) || '-----END RSA PRIVATE KEY-----' || chr(10)"

# Cards in SQL: cut at the candidates, check each by Luhn, put together again.
CARDS_SQL = f"""
pieces AS (SELECT *, regexp_extract_all(text, '{CARD}') AS hits, regexp_split_to_array(text, '{CARD}') AS parts FROM src),
judged AS (SELECT *, list_transform(hits, lambda h: CASE WHEN length(regexp_replace(h, '[ -]', '', 'g')) BETWEEN 13 AND 19
 AND list_sum(list_transform(range(1, length(regexp_replace(h, '[ -]', '', 'g')) + 1), lambda i:
  CASE WHEN (length(regexp_replace(h, '[ -]', '', 'g')) - i) % 2 = 0 THEN CAST(substr(regexp_replace(h, '[ -]', '', 'g'), i, 1) AS INT)
  ELSE CAST(substr(regexp_replace(h, '[ -]', '', 'g'), i, 1) AS INT) * 2 // 10 + CAST(substr(regexp_replace(h, '[ -]', '', 'g'), i, 1) AS INT) * 2 % 10 END)) % 10 = 0
 THEN '[Filtered]' ELSE h END) AS fixed FROM pieces),
carded AS (SELECT *, CASE WHEN len(hits) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(fixed[i], '')), '') END AS out FROM judged)"""


@query("x01_scrub_documents", f"""
WITH src AS (SELECT doc_id, regexp_replace(CASE WHEN lang = 'fr' THEN text || {BLOCK} || text ELSE text END, '{PEM}', '[Filtered]', 'g') AS text FROM documents),
{CARDS_SQL}
SELECT doc_id, md5(regexp_replace(out, '{EMAIL}', '[Filtered]', 'g')) AS digest, length(regexp_replace(out, '{EMAIL}', '[Filtered]', 'g')) AS n FROM carded""")
def scrub_documents(t: Tables):
    """Whole texts; French ones also carry a private key block."""
    block = F.lit("\n-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----\n")
    text = F.when(F.col("lang") == "fr", F.concat("text", block, "text")).otherwise(F.col("text"))
    scrubbed = pii.scrub_value(text, emails=True)
    out = t.spread("documents").select("doc_id", scrubbed.alias("clean"))
    return out.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").cast("bigint").alias("n"))


@query("x01_scrub_conversations", f"""
WITH src AS (SELECT conv_id, turn, text || ' ' || CASE WHEN turn % 2 = 0 THEN '4111 1111-1111 1111' ELSE '4111111111111112' END || ', me+' || role || '@mail.example.co.uk.' AS text FROM conversations),
{CARDS_SQL}
SELECT conv_id, turn, md5(regexp_replace(out, '{EMAIL}', '[Filtered]', 'g')) AS digest FROM carded""")
def scrub_conversations(t: Tables):
    card = F.when(F.col("turn") % 2 == 0, F.lit("4111 1111-1111 1111")).otherwise(F.lit("4111111111111112"))
    text = F.concat("text", F.lit(" "), card, F.lit(", me+"), "role", F.lit("@mail.example.co.uk."))
    return t.spread("conversations").select("conv_id", "turn", F.md5(pii.scrub_value(text, emails=True)).alias("digest"))


KEYS = """CASE event_id % 16 WHEN 0 THEN 'auth_token' WHEN 1 THEN 'author' WHEN 2 THEN 'userPassword' WHEN 3 THEN 'X-Api-Key' WHEN 4 THEN 'tokenizer' WHEN 5 THEN 'sessionId'
 WHEN 6 THEN 'card_number' WHEN 7 THEN 'HTTPAuthHeader' WHEN 8 THEN 'my secret.value' WHEN 9 THEN 'pinned' WHEN 10 THEN event_type WHEN 11 THEN 'publicToken' WHEN 12 THEN 'internal-code'
 WHEN 13 THEN '' WHEN 14 THEN 'PIN' ELSE 'Set_Cookie' END"""
# Fixed values, written out so that the check does not follow a mistake in the package's lists.
TOKEN_LIST = """'password', 'passwd', 'passphrase', 'pwd', 'pin', 'secret', 'auth', 'bearer', 'credentials', 'token', 'session', 'cookie', 'csrf', 'xsrf', 'ssn',
 'cvv', 'cvc'"""
WHOLE_LIST = """'apikey', 'xapikey', 'authorization', 'csrftoken', 'xcsrftoken', 'sessionid', 'setcookie', 'connectsid', 'aiohttpsession', 'mysqlpwd', 'xforwardedfor',
 'privatekey', 'creditcard', 'cardnumber', 'socialsecurity'"""


@query("x02_scrub_map", f"""
WITH k AS (SELECT event_id, {KEYS} AS key, CAST(user_id AS VARCHAR) AS value FROM events),
n AS (SELECT *, lower(regexp_replace(key, '[-_.\\s]', '', 'g')) AS name,
 list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[-_.\\s]+'), lambda x: x <> '') AS tokens FROM k),
c AS (SELECT event_id, key, value, name <> '' AND name <> 'public' AND (name IN ({WHOLE_LIST}, 'internalcode') OR (list_has_any(tokens, [{TOKEN_LIST}]) AND NOT list_contains(tokens, 'public'))) AS by_token,
 name <> '' AND NOT contains(name, 'public') AND len(list_filter([{TOKEN_LIST}, {WHOLE_LIST}, 'internalcode'], lambda x: contains(name, x))) > 0 AS by_text FROM n)
SELECT event_id, key, CASE WHEN by_token THEN '[Filtered]' ELSE value END AS token_value, CASE WHEN by_text THEN '[Filtered]' ELSE value END AS aggressive_value FROM c""")
def scrub_map(t: Tables):
    rows = t.spread("events").select("event_id", F.expr(KEYS).alias("key"), F.col("user_id").cast("string").alias("value"))
    tags, rules = F.create_map("key", "value"), {"sensitive": ["Internal-Code"], "safe": ["public"]}
    return rows.select(
        "event_id", "key", pii.scrub_map(tags, **rules)[F.col("key")].alias("token_value"),
        pii.scrub_map(tags, aggressive=True, **rules)[F.col("key")].alias("aggressive_value"),
    )


CONFIGS = """CASE project_id % 4 WHEN 0 THEN '{"enabled": true, "scrub_emails": true, "placeholder": "[gone]"}' WHEN 1 THEN NULL WHEN 2 THEN '{broken' ELSE '{"enabled": true, "safe_keys": ["password"]}' END"""
DEFAULT_CONFIG = '{"enabled": true, "sensitive_keys": ["color"]}'


def configs(t: Tables):
    return t("projects").select("project_id", pii.resolve_config(F.expr(CONFIGS), F.lit(DEFAULT_CONFIG)).alias("config"))


@query("x04_scrub_config", """
SELECT project_id, project_id % 4 <> 2 AS enabled, project_id % 4 = 0 AS scrub_emails, CASE project_id % 4 WHEN 0 THEN '[gone]' ELSE '[Filtered]' END AS placeholder,
 CASE project_id % 4 WHEN 1 THEN 'color' ELSE '' END AS sensitive, CASE project_id % 4 WHEN 3 THEN 'password' ELSE '' END AS safe, TRUE AS scrub_defaults FROM projects""")
def scrub_config(t: Tables):
    c = F.col("config")
    return configs(t).select(
        "project_id", c["enabled"].alias("enabled"), c["scrub_emails"].alias("scrub_emails"), c["placeholder"].alias("placeholder"),
        F.array_join(c["sensitive_keys"], ",").alias("sensitive"), F.array_join(c["safe_keys"], ",").alias("safe"), c["scrub_defaults"].alias("scrub_defaults"),
    )


@query("x03_scrub_json", """
WITH x AS (SELECT event_id, event_type, user_id % 5 % 4 AS p, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT event_id, CASE p WHEN 0 THEN '[gone]' WHEN 1 THEN '[Filtered]' ELSE 'x' || u END AS password, CASE p WHEN 0 THEN '[gone]' WHEN 2 THEN 'tok' ELSE '[Filtered]' END AS header,
 CASE p WHEN 0 THEN 'mail [gone] now' ELSE 'mail a@b.example now' END AS message, CASE p WHEN 1 THEN '[Filtered]' ELSE 'red' END AS color,
 CASE p WHEN 0 THEN 'card [gone]' WHEN 2 THEN 'card 4111111111111111' ELSE 'card [Filtered]' END AS card, 'top' || u AS outside FROM x""")
def scrub_json(t: Tables):
    """Nested payloads, each scrubbed by its project's own configuration."""
    user = F.col("user_id").cast("string")
    doc = F.concat(
        F.lit('{"password":"top'), user, F.lit('","extra":{"deep":[{"password":"x'), user, F.lit('","color":"red"}]},"request":{"headers":[["X-Auth-Token","tok"],["Host","h"]]},'),
        F.lit('"message":"mail a@b.example now","breadcrumbs":{"values":[{"data":{"note":"card 4111111111111111"}}]}}'),
    )
    rows = t.spread("events").select("event_id", (F.col("user_id") % 5).alias("project_id"), doc.alias("payload")).join(configs(t), "project_id", "left")
    clean = pii.scrub_json(rows, "payload", "config")
    get = lambda path: F.get_json_object("payload", path)
    return clean.select(
        "event_id", get("$.extra.deep[0].password").alias("password"), get("$.request.headers[0][1]").alias("header"), get("$.message").alias("message"),
        get("$.extra.deep[0].color").alias("color"), get("$.breadcrumbs.values[0].data.note").alias("card"), get("$.password").alias("outside"),
    )


@query("x03_broken_and_deep", """
SELECT event_id, event_id % 4 AS kind, CASE event_id % 4 WHEN 0 THEN '{"extra":{"password":"[Filtered]","n":"card [Filtered]"},"top":"cut' WHEN 1 THEN '[Filtered]'
 WHEN 2 THEN '{"password":"kept' || CAST(user_id AS VARCHAR) || '"}' ELSE 'plain [Filtered] text' END AS clean, event_id % 4 IN (0, 3) AS rejected FROM events""")
def scrub_broken_and_deep(t: Tables):
    """Cut-off JSON, a password below 200 levels, a row without config, and text that is no JSON."""
    user, levels = F.col("user_id").cast("string"), 200
    kinds = {
        0: F.concat(F.lit('{"extra":{"password":"x'), user, F.lit('","n":"card 4111111111111111"},"top":"cut')),
        1: F.concat(F.lit('{"extra":' + '{"a":[' * levels + '{"password":"x'), user, F.lit('"}' + "]}" * levels + "}")),
        2: F.concat(F.lit('{"password":"kept'), user, F.lit('"}')),
        3: F.lit("plain 4111111111111111 text"),
    }
    kind = (F.col("event_id") % 4).cast("int")
    payload = reduce(lambda chain, k: chain.when(kind == k, kinds[k]), (1, 2, 3), F.when(kind == 0, kinds[0]))
    on = pii.resolve_config(F.lit('{"enabled": true}'), F.lit(None).cast("string"))
    rows = t.spread("events").select("event_id", F.col("event_id") % 4, payload.alias("payload"), F.when(kind != 2, on).alias("config")).toDF("event_id", "kind", "payload", "config")
    clean = pii.scrub_json(rows, "payload", "config", rejected="rejected")
    deep = F.get_json_object("payload", "$.extra" + ".a[0]" * levels + ".password")
    return clean.select("event_id", "kind", F.when(F.col("kind") == 1, deep).otherwise(F.col("payload")).alias("clean"), "rejected")
