"""JSON inputs: event envelopes, log items, OTLP log exports, user feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.otel import any_value, epoch_nanos_to_timestamp, resource_attributes
from ..functions.levels import severity_level
from ..functions.text import non_empty, truncate

ENVELOPE = "struct<type:string,project_id:int,organization_id:int,received:string,payload:string,_bad:string>"
ITEM_TABLES = {"event": "events", "transaction": "transactions", "log": "logs", "user_report": "reports", "feedback": "reports"}
LOG_ITEM = (
    "struct<timestamp:string,level:string,body:string,service:string,environment:string,host:string,"
    "trace_id:string,span_id:string,severity_number:int,attributes:map<string,string>,_bad:string>"
)
# Both spellings of the export format (snake and camel case) are read.
ATTRIBUTE = "struct<key:string,value:string>"
RECORD = (
    "struct<time_unix_nano:string,timeUnixNano:string,observed_time_unix_nano:string,observedTimeUnixNano:string,"
    "severity_number:string,severityNumber:string,severity_text:string,severityText:string,body:string,"
    f"trace_id:string,traceId:string,span_id:string,spanId:string,attributes:array<{ATTRIBUTE}>>"
)
SCOPE = f"struct<log_records:array<{RECORD}>,logRecords:array<{RECORD}>>"
RESOURCE = f"struct<resource:struct<attributes:array<{ATTRIBUTE}>>,scope_logs:array<{SCOPE}>,scopeLogs:array<{SCOPE}>>"
EXPORT = f"struct<resource_logs:array<{RESOURCE}>,resourceLogs:array<{RESOURCE}>>"


def _ddl(text: str) -> T.DataType:
    return T.DataType.fromDDL(text)


def decode(lines: DataFrame, ddl: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed columns of well-formed lines, and the raw text of the others."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("_row", F.from_json(F.col(column), _ddl(ddl), options))
    broken = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    fields = [f for f in _ddl(ddl).fieldNames() if f != "_bad"]
    good = parsed.where(~broken).select(
        *[c for c in lines.columns if c != column], *[F.col("_row")[f].alias(f) for f in fields]
    )
    return good, parsed.where(broken).select(*lines.columns)


def read_envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelope items routed by type; malformed lines and unknown types go to the second table."""
    good, bad = decode(lines, ENVELOPE)
    target = F.create_map(*[F.lit(x) for pair in ITEM_TABLES.items() for x in pair])
    routed = good.withColumn("table", F.try_element_at(target, F.col("type"))).withColumn(
        "received", F.col("received").try_cast("timestamp").cast("timestamp_ntz")
    )
    return routed, bad


def read_log_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SDK log items: typed attribute values are unwrapped, ISO or epoch time is read."""
    good, bad = decode(lines, LOG_ITEM)
    epoch = F.timestamp_micros((F.col("timestamp").try_cast("double") * F.lit(1e6)).cast("bigint")).cast("timestamp_ntz")
    iso = F.col("timestamp").try_cast("timestamp").cast("timestamp_ntz")
    is_epoch = F.col("timestamp").rlike(r"^[0-9.eE+]+$")
    return good.withColumn("timestamp", F.when(is_epoch, epoch).otherwise(iso)).withColumn(
        "attributes", F.transform_values("attributes", lambda k, v: _typed_value(v))
    ), bad


def _typed_value(raw: Column) -> Column:
    return F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$.value"), raw)).otherwise(raw)


def _attribute_map(attributes: Column) -> Column:
    usable = F.filter(attributes, lambda a: a["key"].isNotNull())
    return F.coalesce(
        F.map_from_entries(F.transform(usable, lambda a: F.struct(a["key"].alias("k"), any_value(a["value"]).alias("v")))),
        F.create_map().cast("map<string,string>"),
    )


def read_otlp(lines: DataFrame, column: str = "value") -> DataFrame:
    """OTLP/JSON log exports to log items; record attributes win over resource attributes."""
    doc = F.from_json(F.col(column), _ddl(EXPORT))
    keep = [c for c in lines.columns if c != column]
    resources = lines.select(*keep, F.explode(F.coalesce(doc["resourceLogs"], doc["resource_logs"])).alias("r"))
    scopes = resources.select(
        *keep, resource_attributes(_attribute_map(F.col("r.resource.attributes"))).alias("shared"),
        F.explode(F.coalesce(F.col("r.scopeLogs"), F.col("r.scope_logs"))).alias("s"),
    )
    rows = scopes.select(*keep, "shared", F.explode(F.coalesce(F.col("s.logRecords"), F.col("s.log_records"))).alias("l"))
    number = F.coalesce("l.severity_number", "l.severityNumber").try_cast("int")
    number = F.when(number != 0, number)
    text = F.coalesce(non_empty(F.col("l.severity_text")), F.col("l.severityText"))
    return rows.select(
        *keep,
        epoch_nanos_to_timestamp(
            F.col("l.time_unix_nano"), F.col("l.timeUnixNano"), F.col("l.observed_time_unix_nano"), F.col("l.observedTimeUnixNano")
        ).cast("timestamp_ntz").alias("timestamp"),
        severity_level(number, text).alias("level"), F.coalesce(any_value(F.col("l.body")), F.lit("")).alias("body"),
        F.coalesce(non_empty(F.col("l.trace_id")), F.col("l.traceId")).alias("trace_id"),
        F.coalesce(non_empty(F.col("l.span_id")), F.col("l.spanId")).alias("span_id"), number.alias("severity_number"),
        F.map_concat("shared", _attribute_map(F.col("l.attributes"))).alias("attributes"),
    )


def read_reports(payload: Column) -> Column:
    """Both feedback shapes to one report struct (name up to 128, e-mail up to 254 characters)."""
    old = F.from_json(payload, "struct<event_id:string,name:string,email:string,comments:string,contexts:string>")
    new = F.from_json(
        old["contexts"], "struct<feedback:struct<message:string,name:string,contact_email:string,associated_event_id:string>>"
    )["feedback"]
    is_new = old["contexts"].isNotNull()
    pick = lambda a, b: F.coalesce(F.when(is_new, a).otherwise(b), F.lit(""))
    return F.struct(
        F.when(is_new, new["associated_event_id"]).otherwise(old["event_id"]).alias("event_id"),
        truncate(pick(new["name"], old["name"]), 128).alias("name"),
        truncate(pick(new["contact_email"], old["email"]), 254).alias("email"),
        pick(new["message"], old["comments"]).alias("comments"),
    )


def capture_errors(raw: Column, fields: dict[str, str]) -> tuple[dict[str, Column], Column]:
    """Parse JSON fields one by one: a bad one becomes null and is listed in ``errors``.

    ``fields`` maps a field name to its DDL type.
    """
    values, errors = {}, []
    for name, ddl in fields.items():
        text = F.get_json_object(raw, f"$.{name}")
        value = text.try_cast(ddl) if "<" not in ddl else F.from_json(text, ddl, {"mode": "PERMISSIVE"})
        if "<" in ddl:
            value = F.when(text.startswith("{") | text.startswith("["), value)
        values[name] = value
        errors.append(F.when(text.isNotNull() & value.isNull(), F.struct(
            F.lit("invalid_data").alias("type"), F.lit(name).alias("name"), text.alias("value")
        )))
    return values, F.array_compact(F.array(*errors))
