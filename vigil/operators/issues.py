"""Issues: grouping, counters, tags, merging, reopening, search, views."""

from __future__ import annotations

import shlex
from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import levels as L
from ..functions.ids import is_uuid7, uuid7_timestamp
from ..functions.text import clean_tag, short_id
from ..functions.timeparam import moment
from .segmented import join_on_keys, time_slot, with_neighbours, with_row_number, written_once
from .upsert import add_counts, first_per_key, latest_per_key, update_matching, without

UNRESOLVED, RESOLVED, IGNORED = 0, 1, 2
ERROR_LEVEL = 4
EVENT_KEYS = ["project_id", "hash"]
SLOT = 60  # seconds per segment of an issue's history


# -- counters ------------------------------------------------------------------------

def hourly_counts(events: DataFrame, *keys: str, time: str = "received") -> DataFrame:
    """Events per hour of ``time`` and keys."""
    return events.groupBy(*keys, F.date_trunc("hour", time).cast("timestamp_ntz").alias("date")).agg(F.count(F.lit(1)).alias("count"))


def tag_rows(events: DataFrame) -> DataFrame:
    """Explode the ``tags`` map of events to cleaned (key, value) rows."""
    return events.select("*", F.explode("tags").alias("tag_key", "tag_value")).drop("tags").withColumn(
        "tag_key", clean_tag(F.col("tag_key"))
    ).withColumn("tag_value", clean_tag(F.col("tag_value")))


def daily_tag_counts(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(
        F.date_trunc("day", "received").cast("timestamp_ntz").alias("date"), "issue_id", "organization_id", "tag_key", "tag_value"
    ).agg(F.count(F.lit(1)).alias("count"))


def rollup_updates(events: DataFrame) -> DataFrame:
    """Per issue: events added, last sighting, release of the newest event that has one."""
    counts = events.groupBy("issue_id").agg(F.count(F.lit(1)).alias("added"), F.max("received").alias("last_seen"))
    return join_on_keys(counts, last_releases(events, ["issue_id"]), ["issue_id"], "left")


def last_releases(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the release of the newest event that has one."""
    named = events.where("release IS NOT NULL").select(*keys, "received", "event_id", F.col("release").alias("last_release"))
    return latest_per_key(named, keys, ["received", "event_id"]).select(*keys, "last_release")


def apply_rollup(issues: DataFrame, updates: DataFrame) -> DataFrame:
    """Stored issues with a batch's updates; a batch release overrides the stored one."""
    u = updates.select("issue_id", "added", F.col("last_seen").alias("_seen"), F.col("last_release").alias("_release"))
    return issues.join(u, "issue_id", "left").withColumn("count", F.col("count") + F.coalesce("added", F.lit(0))).withColumn(
        "last_seen", F.greatest("last_seen", "_seen")
    ).withColumn("last_release", F.coalesce("_release", "last_release")).drop("added", "_seen", "_release")


# -- grouping ------------------------------------------------------------------------

def group_batch(events: DataFrame) -> DataFrame:
    """One row per (project, hash) of a batch, titled by its first event."""
    counts = events.groupBy(*EVENT_KEYS).agg(
        F.count(F.lit(1)).alias("count"), F.min("received").alias("first_seen"), F.max("received").alias("last_seen")
    )
    named = ["title", "culprit", "type", "level", "organization_id", "release"]
    first = first_per_key(events.select(*EVENT_KEYS, "received", "event_id", *named), EVENT_KEYS, ["received", "event_id"])
    first = first.select(*EVENT_KEYS, *named).withColumnRenamed("release", "first_release")
    return join_on_keys(join_on_keys(counts, first, EVENT_KEYS), last_releases(events, EVENT_KEYS), EVENT_KEYS, "left")


def issue_key(project: Column, hash_: Column) -> Column:
    """Id of a new issue, a function of its key so that a retried task mints the same one."""
    return F.concat(project.cast("string"), F.lit("-"), hash_)


def new_issues(batch: DataFrame, hashes: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Groups of a batch that no stored hash knows, with the next short ids of their project."""
    # Groups are few beside events; numbering reads them several times.
    unseen = written_once(join_on_keys(batch, hashes, EVENT_KEYS, "left_anti"), "unseen")
    numbered = with_row_number(unseen, ["project_id"], time_slot(F.col("first_seen"), SLOT), ["first_seen", "hash"], "short_id")
    if counters is not None:
        top = counters.groupBy("project_id").agg(F.max("short_id").alias("_top"))
        numbered = numbered.join(top, "project_id", "left").withColumn(
            "short_id", F.col("short_id") + F.coalesce("_top", F.lit(0))
        ).drop("_top")
    return numbered.withColumn("issue_id", issue_key(F.col("project_id"), F.col("hash"))).withColumn(
        "status", F.lit(UNRESOLVED)
    ).withColumn("level", F.coalesce("level", F.lit(ERROR_LEVEL)))


def link_events(events: DataFrame, hashes: DataFrame) -> DataFrame:
    """Events with the id (and state) of the issue their hash belongs to."""
    return join_on_keys(events, hashes, EVENT_KEYS, "left")


def issues_to_reopen(linked: DataFrame) -> DataFrame:
    """Resolved issues that a new event reopens.

    Resolved without a release: any event; else only an event of another release.
    """
    other = F.col("release").isNotNull() & (F.col("release") != F.col("resolved_in_release"))
    hit = (F.col("status") == RESOLVED) & (F.col("resolved_in_release").isNull() | other)
    return linked.where(hit).select("issue_id").distinct()


def reopen(issues: DataFrame, ids: DataFrame) -> DataFrame:
    return update_matching(
        issues, ids, ["issue_id"], status=F.lit(UNRESOLVED), resolved_in_release=F.lit(None).cast("string")
    )


def drop_notifications(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove every notification that mentions one of the issues (all its links)."""
    hit = links.join(ids, "issue_id", "left_semi").select("notification_id").distinct()
    return without(links, hit, ["notification_id"])


# -- bulk changes ------------------------------------------------------------------

def set_status(issues: DataFrame, chosen: DataFrame, status: int) -> DataFrame:
    return update_matching(issues, chosen, ["issue_id"], status=F.lit(status))


def parse_assignee(text: str | None) -> tuple[str | None, str | None]:
    """``user:<id>``, ``team:<slug>`` or an e-mail to (kind, key); empty unassigns."""
    if not text:
        return None, None
    kind, _, key = text.partition(":")
    if kind == "user":
        return "user", str(int(key))
    if kind == "team":
        return "team", key
    return "email", text


def assign(issues: DataFrame, requests: DataFrame, members: DataFrame, teams: DataFrame) -> DataFrame:
    """Apply assignment requests (issue_id, assigned_to) to issues: a user xor a team.

    Unknown users or teams (or those of another organisation) leave the issue alone;
    an empty request unassigns it.
    """
    asked = requests.withColumn(
        "kind", F.when(F.coalesce("assigned_to", F.lit("")) == "", "none").when(F.col("assigned_to").startswith("team:"), "team")
        .when(F.col("assigned_to").startswith("user:"), "user").otherwise("email")
    ).withColumn("key", F.when(F.col("kind").isin("team", "user"), F.substring("assigned_to", 6, 255)).otherwise(F.col("assigned_to")))
    # One row per name a member answers to: by user id and by e-mail.
    people = members.select(
        F.col("organization_id").alias("_org"), F.col("user_id").alias("_user"),
        F.explode(F.array(
            F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("key")),
            F.struct(F.lit("email").alias("kind"), F.col("email").alias("key")),
        )).alias("_name"),
    ).select("_org", "_user", F.col("_name.kind").alias("_kind"), F.col("_name.key").alias("_key"))
    groups = teams.select(F.col("organization_id").alias("_torg"), F.col("team_id").alias("_team"), F.col("slug").alias("_slug"))
    rows = issues.join(asked, "issue_id", "left")
    rows = rows.join(people, (F.col("organization_id") == F.col("_org")) & (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")), "left")
    rows = rows.join(groups, (F.col("kind") == "team") & (F.col("organization_id") == F.col("_torg")) & (F.col("key") == F.col("_slug")), "left")
    known = F.col("_user").isNotNull() | F.col("_team").isNotNull() | (F.col("kind") == "none")
    return rows.withColumn("assigned_user", F.when(known, F.col("_user")).otherwise(F.col("assigned_user"))).withColumn(
        "assigned_team", F.when(known, F.col("_team")).otherwise(F.col("assigned_team"))
    ).select(*issues.columns)


def final_targets(mapping: DataFrame, rounds: int = 32) -> DataFrame:
    """A mapping (source_id, target_id) in which no target is itself a source: chains are followed to their end.

    Each round doubles the length that is followed; a cycle is an error.
    """
    pairs = mapping.select("source_id", "target_id").where("source_id <> target_id").distinct()
    for _ in range(rounds):
        further = pairs.select(F.col("source_id").alias("_source"), F.col("target_id").alias("_target"))
        hops = pairs.join(further, F.col("target_id") == F.col("_source"), "left")
        if not hops.where("_target IS NOT NULL").take(1):
            return pairs
        pairs = hops.select("source_id", F.coalesce("_target", "target_id").alias("target_id"))
        if pairs.where("source_id = target_id").take(1):
            break
    raise ValueError("issues cannot be merged in a circle")


def merge_issues(issues: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merge sources into targets (source_id, target_id): counts move, sources are soft-deleted.

    All events of a source move with it; of a chain of merges, to its end.
    """
    mapping = final_targets(mapping)
    counts = issues.join(mapping, issues["issue_id"] == mapping["source_id"]).where("source_id <> target_id").groupBy(
        F.col("target_id").alias("_target")
    ).agg(F.sum("count").alias("_moved"))
    sources = mapping.where("source_id <> target_id").select(F.col("source_id").alias("_source")).distinct()
    return issues.join(counts, issues["issue_id"] == F.col("_target"), "left").join(
        sources, issues["issue_id"] == F.col("_source"), "left"
    ).withColumn("count", F.col("count") + F.coalesce("_moved", F.lit(0))).withColumn(
        "is_deleted", F.col("is_deleted") | F.col("_source").isNotNull()
    ).select(*issues.columns)


def repoint(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move the rows of merged issues (events, hashes) to their target, along a chain to its end."""
    return rows.join(final_targets(mapping).select(F.col("source_id").alias("issue_id"), "target_id"), "issue_id", "left").withColumn(
        "issue_id", F.coalesce("target_id", "issue_id")
    ).select(*rows.columns)


# -- reading -----------------------------------------------------------------------

def latest_events(events: DataFrame, keys: Sequence[str] = ("issue_id",), order: Sequence[str] = ("received", "event_id")) -> DataFrame:
    """Newest event of each issue."""
    return latest_per_key(events, keys, order)


def event_neighbours(events: DataFrame, key: str = "issue_id") -> DataFrame:
    """Previous and next event id of every event inside its issue (or project)."""
    return with_neighbours(events, [key], time_slot(F.col("received"), SLOT), ["received", "event_id"], "event_id")


def latest_event_per_hash(hashes: DataFrame, events: DataFrame) -> DataFrame:
    """Newest event whose ``hashes`` array holds the hash, per project."""
    exploded = events.select("project_id", "event_id", "received", F.explode("hashes").alias("hash"))
    newest = exploded.groupBy(*EVENT_KEYS).agg(F.max_by("event_id", F.struct("received", "event_id")).alias("latest_event_id"))
    return join_on_keys(hashes, newest, EVENT_KEYS, "left")


def distinct_tags(tags: DataFrame) -> DataFrame:
    """Every tag key and value of a batch once (``kind``, ``name``)."""
    kinds = F.explode(F.array(F.struct(F.lit("key").alias("kind"), F.col("tag_key").alias("name")), F.struct(F.lit("value").alias("kind"), F.col("tag_value").alias("name"))))
    return tags.select(kinds.alias("tag")).select("tag.*").distinct()


def hash_list(hashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Hashes of issues, ordered by value."""
    ordered = hashes.orderBy("hash", "project_id")
    return ordered if limit is None else ordered.limit(limit)


def find_event(events: DataFrame, uid: Column, now: datetime, days: int = 90) -> DataFrame:
    """An event by its id: a time-ordered one leads to its day, a client id is looked for in the last days.

    Events have ``id``, ``client_id``, ``received`` and the partition column ``date``.
    """
    at = F.to_date(uuid7_timestamp(uid))
    own = is_uuid7(uid) & (F.col("id") == uid) & (F.col("date") == at)
    client = ~is_uuid7(uid) & (F.col("client_id") == uid) & (F.col("received") >= moment(now - timedelta(days=days)))
    return events.where(own | client)


def tag_breakdown(tags: DataFrame, *, top: int | None = None) -> DataFrame:
    """Value totals per issue and tag key, with the key's unique and total counts.

    One row per value instead of a list per key: a key may have any number of values.
    """
    values = tags.groupBy("issue_id", "tag_key", "tag_value").agg(F.sum("count").alias("value_count"))
    keys = values.groupBy("issue_id", "tag_key").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("value_count").alias("total_values")
    )
    out = values.join(keys, ["issue_id", "tag_key"])
    if top is None:
        return out
    return out.orderBy(F.col("value_count").desc(), "issue_id", "tag_key", "tag_value").limit(top)


def stats_24h(hourly: DataFrame, now: datetime) -> DataFrame:
    """``[epoch, count]`` pairs per issue over the last 24 hours (at most 25 pairs)."""
    return _pairs(hourly.where(F.col("date") >= moment(now - timedelta(hours=24))), F.col("date"))


def stats_14d(hourly: DataFrame, now: datetime) -> DataFrame:
    """Daily pairs per issue over the last 14 days (at most 15 pairs)."""
    return _pairs(hourly.where(F.col("date") >= moment(now - timedelta(days=14))), F.date_trunc("day", "date"))


def _pairs(hourly: DataFrame, slot: Column) -> DataFrame:
    summed = hourly.groupBy("issue_id", F.unix_seconds(slot.cast("timestamp")).alias("epoch")).agg(F.sum("count").alias("n"))
    return summed.groupBy("issue_id").agg(F.sort_array(F.collect_list(F.struct("epoch", "n"))).alias("pairs"))


def priority(count: Column, last_seen: Column) -> Column:
    return F.log10(count) + F.unix_micros(last_seen.cast("timestamp")) / F.lit(1e6) / F.lit(300000.0)


def sort_issues(issues: DataFrame, sort: str = "-last_seen", limit: int | None = None) -> DataFrame:
    field = sort.lstrip("-")
    key = priority(F.col("count"), F.col("last_seen")) if field == "priority" else F.col(field)
    ordered = issues.orderBy(key.desc() if sort.startswith("-") else key.asc(), F.col("issue_id"))
    return ordered if limit is None else ordered.limit(limit)


def find_issues(
    issues: DataFrame, tags: DataFrame, *, query: str | None = None, environments: Iterable[str] | None = None,
    ids: Iterable | None = None, projects: Iterable[int] | None = None,
    first_seen_from: datetime | None = None, first_seen_to: datetime | None = None, hide_deleted: bool = True,
) -> DataFrame:
    """Issue list filters and the structured query language (``is: has: level: key:value text``).

    Every tag condition is a semi join with the matching tag rows; the first word
    without a colon starts the free text, which takes the rest of the query.
    """
    if hide_deleted:
        issues = issues.where(~F.col("is_deleted"))
    if ids is not None:
        issues = issues.where(F.col("issue_id").isin(*ids))
    if projects is not None:
        issues = issues.where(F.col("project_id").isin(*projects))
    if first_seen_from is not None:
        issues = issues.where(F.col("first_seen") >= moment(first_seen_from))
    if first_seen_to is not None:
        issues = issues.where(F.col("first_seen") <= moment(first_seen_to))

    def having(key: str, values: list[str] | None) -> None:
        nonlocal issues
        rows = tags.where(F.col("tag_key") == key)
        if values is not None:
            rows = rows.where(F.col("tag_value").isin(*values))
        issues = issues.join(rows.select("issue_id").distinct(), "issue_id", "left_semi")

    if environments:
        having("environment", list(environments))
    try:
        words = shlex.split(query or "")
    except ValueError:
        words = (query or "").split()
    for at, word in enumerate(words):
        name, colon, value = word.partition(":")
        value = value.strip('"')
        if not colon:
            issues = issues.where(text_match(" ".join(words[at:])))
            break
        if name == "is":
            issues = issues.where(F.col("status") == _number_of(L.ISSUE_STATUSES, value))
        elif name == "level":
            issues = issues.where(F.col("level") == _number_of(L.ISSUE_LEVELS, value))
        elif name == "has":
            having(value, None)
        else:
            having(name, [value])
    return issues


def _number_of(labels: dict[int, str], name: str) -> Column:
    return F.lit(next((n for n, label in labels.items() if label == name), None)).cast("int")


def text_match(text: str) -> Column:
    """All words among the issue's search terms; with ``*`` also a wildcard title match."""
    wanted = terms(F.lit(text))
    found = (F.size(wanted) > 0) & F.forall(wanted, lambda w: F.array_contains(F.col("terms"), w))
    if "*" in text:
        return F.col("title").ilike(f"%{text.replace('*', '%')}%") | found
    return found


# Words too common to search for.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now"
).split()


def terms(text: Column) -> Column:
    """Distinct lower-case words without stop words (words are not stemmed)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def append_terms(existing: Column, text: Column, most: int | None = None) -> Column:
    """Add a text's terms to a term set, in order; ``most`` keeps the first of them."""
    empty = F.array().cast("array<string>")
    merged = F.array_sort(F.array_union(F.coalesce(existing, empty), F.coalesce(terms(text), empty)))
    return merged if most is None else F.slice(merged, 1, most)


def issue_terms(events: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Term set per issue from many events: distinct (issue, term) rows first; ``most`` keeps the first terms."""
    rows = events.select("issue_id", F.explode(terms(F.col(text))).alias("term")).distinct()
    if most is not None:
        rows = with_row_number(rows, ["issue_id"], F.substring("term", 1, 2), ["term"], "at").where(F.col("at") <= most)
    return rows.groupBy("issue_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def with_child_counts(issues: DataFrame, **children: DataFrame) -> DataFrame:
    """Distinct child rows per issue; each child is counted before it is joined."""
    for name, rows in children.items():
        issues = issues.join(rows.groupBy("issue_id").agg(F.count(F.lit(1)).alias(name)), "issue_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0))
        )
    return issues


def issue_view(issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Display row: labels, short id, release of the resolution, assignee."""
    slugs = projects.select("project_id", F.col("slug").alias("project_slug"))
    return issues.join(slugs, "project_id", "left").select(
        "issue_id", "title", F.coalesce("culprit", F.lit("")).alias("culprit"), "project_slug",
        L.issue_type_label(F.col("type")).alias("type"), L.issue_level_label(F.col("level")).alias("level"),
        L.issue_colour(F.col("level")).alias("colour"), L.issue_status_label(F.col("status")).alias("status"),
        short_id(F.col("project_slug"), F.col("short_id")).alias("short_id"),
        F.when((F.col("status") == RESOLVED), F.col("resolved_in_release")).alias("in_release"),
        F.when(F.col("assigned_user").isNotNull(), "user").when(F.col("assigned_team").isNotNull(), "team").alias("assignee_type"),
        F.coalesce(F.col("assigned_user").cast("string"), F.col("assigned_team").cast("string")).alias("assignee_id"),
        F.col("count").cast("string").alias("count"), "first_release", "last_release",
    )


def link_reports(reports: DataFrame, events: DataFrame, now: datetime) -> DataFrame:
    """User reports with the issue of the event they name (same organisation, last 7 days).

    Invalid ids are dropped, a missing id gets a generated one, the first report per
    (project, event) is kept.
    """
    canonical = r"^[0-9a-f]{32}$"
    bare = F.lower(F.regexp_replace("event_ref", "[{}-]", ""))
    given = F.coalesce("event_ref", F.lit("")) != ""
    valid = reports.where(~given | bare.rlike(canonical)).withColumn(
        "event_ref", F.when(given, bare).otherwise(F.md5(F.concat_ws(":", "project_id", "report_key")))
    ).withColumn("_given", given)
    kept = first_per_key(valid, ["project_id", "event_ref"], ["report_key"])
    recent = events.where(F.col("received") >= moment(now - timedelta(days=7))).groupBy(
        F.col("organization_id").alias("_org"), F.col("event_ref").alias("_ref")
    ).agg(F.max("issue_id").alias("issue_id"))
    cond = kept["_given"] & (kept["organization_id"] == recent["_org"]) & (kept["event_ref"] == recent["_ref"])
    return kept.join(recent, cond, "left").drop("_org", "_ref", "_given")


def merge_hourly(stored: DataFrame, batch: DataFrame, *keys: str) -> DataFrame:
    return add_counts(stored, batch, [*keys, "date"])
