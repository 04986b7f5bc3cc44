"""Releases, environments, projects, teams, members: lookups, links, visibility."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.timeparam import moment
from .segmented import join_on_keys
from .upsert import without

RELEASE_DAYS = 365


# -- soft delete and visibility ------------------------------------------------------

def undeleted(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_deleted"))


def deleted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_deleted"))


def live_projects(projects: DataFrame, organizations: DataFrame) -> DataFrame:
    """Projects that are not deleted and whose organisation is not deleted either."""
    return undeleted(projects).join(undeleted(organizations), "organization_id", "left_semi")


def visible_environments(environments: DataFrame, links: DataFrame, visibility: str = "visible") -> DataFrame:
    """Environments with at least one link of the wanted visibility (all, hidden, visible)."""
    if visibility == "all":
        return environments
    wanted = links.where(F.col("is_hidden") == (visibility == "hidden"))
    return environments.join(wanted, ["organization_id", "name"], "left_semi")


def releases_of(releases: DataFrame, links: DataFrame, project_ids: list[int] | None = None, version: str | None = None) -> DataFrame:
    """Releases linked to one of the projects, optionally one version."""
    if version is not None:
        releases = releases.where(F.col("version") == version)
    if project_ids:
        releases = releases.join(links.where(F.col("project_id").isin(*project_ids)), ["organization_id", "version"], "left_semi")
    return releases


# -- batch lookups -----------------------------------------------------------------

def project_context(
    projects: DataFrame, release_links: DataFrame, environment_links: DataFrame, debug_files: DataFrame,
    wanted: DataFrame,
) -> DataFrame:
    """Known (project, release, environment) rows for the pairs of a batch.

    The version condition makes the release join inner in effect; a project without
    any environment keeps a null one.
    """
    flagged = projects.select("project_id").join(
        debug_files.select("project_id").distinct().withColumn("_difs", F.lit(True)), "project_id", "left"
    ).withColumn("has_difs", F.coalesce("_difs", F.lit(False))).drop("_difs")
    versions = release_links.select("project_id", "version").distinct()
    names = environment_links.select("project_id", F.col("name").alias("environment")).distinct()
    rows = flagged.join(versions, "project_id").join(names, "project_id", "left")
    known_versions = wanted.select(F.col("release").alias("version")).where("version IS NOT NULL").distinct()
    known_names = wanted.select("environment").where("environment IS NOT NULL").distinct()
    rows = rows.join(known_versions, "version", "left_semi")
    marked = rows.join(known_names.withColumn("_known", F.lit(True)), "environment", "left")
    return marked.where(F.col("environment").isNull() | F.col("_known")).drop("_known")


def new_dimension_rows(events: DataFrame, stored: DataFrame, column: str, name: str) -> DataFrame:
    """Values of a batch that an organisation does not know yet, with their first sighting."""
    value = F.col(column)
    seen = events.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy("organization_id", value.alias(name)).agg(
        F.min("received").alias("created")
    )
    return without(seen, stored, ["organization_id", name])


def new_links(events: DataFrame, stored: DataFrame, column: str, name: str) -> DataFrame:
    """(org, project, value) pairs of a batch that are not linked yet - every project is linked."""
    value = F.col(column)
    pairs = events.where(F.coalesce(F.col(column), F.lit("")) != "").select("organization_id", "project_id", value.alias(name)).distinct()
    return without(pairs, stored, ["organization_id", "project_id", name])


def stamp_first_event(projects: DataFrame, events: DataFrame) -> DataFrame:
    """Set ``first_event`` once, from the earliest event of a project without one."""
    first = events.groupBy("project_id").agg(F.min("received").alias("_first"))
    return projects.join(first, "project_id", "left").withColumn("first_event", F.coalesce("first_event", "_first")).drop("_first")


def latest_release(releases: DataFrame, links: DataFrame) -> DataFrame:
    """Newest release of every project."""
    joined = links.join(releases.select("organization_id", "version", "created"), ["organization_id", "version"])
    return joined.groupBy("project_id").agg(F.max_by("version", F.struct("created", "version")).alias("version"))


def deploy_counters(releases: DataFrame, deploys: DataFrame, commits: DataFrame, most_commits: int | None = None) -> DataFrame:
    """Deploy and commit counts per release; ``most_commits`` is where a stored commit list ends."""
    d = deploys.groupBy("organization_id", "version").agg(F.count(F.lit(1)).alias("deploy_count"))
    c = commits.groupBy("organization_id", "version").agg(F.count(F.lit(1)).alias("commit_count"))
    out = releases.join(d, ["organization_id", "version"], "left").join(c, ["organization_id", "version"], "left")
    stored = F.coalesce("commit_count", F.lit(0))
    stored = stored if most_commits is None else F.least(stored, F.lit(most_commits))
    return out.select(
        "organization_id", "version", F.coalesce("deploy_count", F.lit(0)).alias("deploy_count"),
        F.coalesce("commit_count", F.lit(0)).alias("commit_count"), stored.alias("stored_commits"),
    )


def old_releases(releases: DataFrame, now: datetime, days: int = RELEASE_DAYS) -> DataFrame:
    return releases.where(F.col("created") < moment(now - timedelta(days=days))).select("organization_id", "version")


def clear_release(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Null every reference to a removed release."""
    keys = gone.select("organization_id", F.col("version").alias("_gone")).distinct()
    for column in columns:
        marked = rows.join(keys, (rows["organization_id"] == keys["organization_id"]) & (rows[column] == keys["_gone"]), "left")
        rows = marked.select(
            *[(F.when(F.col("_gone").isNull(), rows[c]).alias(c) if c == column else rows[c]) for c in rows.columns]
        )
    return rows


# -- people ------------------------------------------------------------------------

def teams_for(teams: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Teams with member count and whether the user belongs to them."""
    counts = members.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("member_count"), (F.count_if(F.col("user_id") == user_id) > 0).alias("is_member")
    )
    return teams.join(counts, "team_id", "left").withColumn("member_count", F.coalesce("member_count", F.lit(0))).withColumn(
        "is_member", F.coalesce("is_member", F.lit(False))
    )


def organizations_with_role(organizations: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The user's organisations with the role held there (the lowest, should there be several)."""
    roles = members.where(F.col("user_id") == user_id).groupBy("organization_id").agg(F.min("role").alias("actor_role"))
    return undeleted(organizations).join(roles, "organization_id")


def recipients(notified: DataFrame, team_projects: DataFrame, members: DataFrame, preferences: DataFrame) -> DataFrame:
    """Users to notify per notification.

    Members of the project's teams, without those who switched the project off and
    without those who have no preference and do not subscribe by default.
    """
    people = notified.join(team_projects, "project_id").join(
        members.select("team_id", "user_id", "subscribe_by_default"), "team_id"
    ).select("notification_id", "project_id", "user_id", "subscribe_by_default").distinct()
    wishes = preferences.groupBy("user_id", "project_id").agg(
        F.count_if(F.col("status") == 0).alias("_off"), F.count(F.lit(1)).alias("_any")
    )
    rows = join_on_keys(people, wishes, ["user_id", "project_id"], "left")
    off = F.coalesce(F.col("_off") > 0, F.lit(False))
    silent = F.col("_any").isNull() & ~F.col("subscribe_by_default")
    return rows.where(~(off | silent)).select("notification_id", "user_id").distinct()
