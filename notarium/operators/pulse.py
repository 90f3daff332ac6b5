"""Roll-up of repositories' status files: what needs action, open issues, team activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import round_half_up

ISSUE_DAYS, NEW_DAYS, ISSUE_CAP, TEAM_CAP = 14, 2, 50, 30
_DAY = 86400.0 * 1e6


def usable(statuses: DataFrame, repo: str | None = None) -> DataFrame:
    rows = statuses.where(F.col("repo") == repo) if repo else statuses
    return rows.where(F.coalesce(F.col("error"), F.lit("")) == "")


def warnings(statuses: DataFrame, repo: str | None = None) -> DataFrame:
    rows = statuses.where(F.col("repo") == repo) if repo else statuses
    return rows.where(F.coalesce(F.col("error"), F.lit("")) != "").select(F.concat(F.col("repo"), F.lit(": "), F.col("error")).alias("warning"))


def age_days(now: Column, at: Column) -> Column:
    """Null where at is no time."""
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(at.cast("string")))) / _DAY


def item_time(item: Column) -> Column:
    """The time by which items of different kinds are sorted, as text."""
    return F.coalesce(item["at"], item["updated_at"], item["merged_at"], item["created_at"], F.lit(""))


def items(statuses: DataFrame, field: str, **more: Column) -> DataFrame:
    """The entries of one list of each status, with their repo."""
    rows = statuses.select("repo", F.explode(field).alias("item"))
    return rows.select("item.*", "repo", *[c.alias(n) for n, c in more.items()], item_time(F.col("item")).alias("sort_at"))


def needs_action(statuses: DataFrame) -> DataFrame:
    both = items(statuses, "awaiting_your_review").unionByName(items(statuses, "recent_activity_on_your_prs"), allowMissingColumns=True)
    return both.orderBy(F.col("sort_at").desc(), "repo", "number")


def waiting(statuses: DataFrame) -> DataFrame:
    return items(statuses, "your_prs_pending_review").orderBy(F.col("sort_at").desc(), "repo", "number")


def team_activity(statuses: DataFrame, cap: int = TEAM_CAP) -> DataFrame:
    merged = items(statuses, "recently_merged", activity_type=F.lit("merged"))
    covered = items(statuses, "demoted_reviews", activity_type=F.lit("review_covered"))
    return merged.unionByName(covered, allowMissingColumns=True).orderBy(F.col("sort_at").desc(), "repo", "number").limit(cap)


def recent_issues(issues: DataFrame, now: Column, cap: int = ISSUE_CAP) -> DataFrame:
    """Issues (repo, number, created_at, updated_at, ...) of the window, flagged new or active, latest first.

    A time that can't be read neither drops an issue nor makes it new.
    """
    kept = issues.where(~F.coalesce(age_days(now, F.col("updated_at")) > ISSUE_DAYS, F.lit(False)))
    new = F.coalesce(age_days(now, F.col("created_at")) <= NEW_DAYS, F.lit(False))
    return kept.withColumns({"is_new": new, "is_active": ~new}).orderBy(F.col("updated_at").desc(), "repo", "number").limit(cap)


def status_issues(statuses: DataFrame) -> DataFrame:
    rows = statuses.select("repo", F.coalesce("worked_on_recently", F.lit(False)).alias("gold"), F.explode("recent_issues").alias("i"))
    return rows.select("repo", "gold", "i.number", "i.title", "i.assignee", "i.created_at", "i.updated_at", "i.labels")


def freshness(statuses: DataFrame, now: Column) -> DataFrame:
    """One row: stale_filtered, and the age in minutes of the oldest update (0 without any)."""
    oldest = F.least(F.unix_micros(now.cast("timestamp")), F.min(F.unix_micros(F.try_to_timestamp(F.col("updated_at").cast("string")))))
    return statuses.agg(
        F.coalesce(F.sum(F.coalesce("stale_filtered", F.lit(0))), F.lit(0)).alias("stale_filtered"),
        round_half_up((F.unix_micros(now.cast("timestamp")) - oldest) / 60e6).alias("data_age_minutes"),
    )


def project_pulse(statuses: DataFrame, now: str, repo: str | None = None) -> dict:
    """The whole roll-up as the tool returns it; its lists are small by their caps or by their nature."""
    at = F.lit(now)
    empty = {"needs_your_action": [], "your_prs_waiting": [], "recent_issues": [], "team_activity": []}
    if statuses.isEmpty():
        return {"as_of": now, **empty, "stale_filtered": 0, "data_age_minutes": -1, "warnings": ["No status.json files found. Run: python3 sync-github.py --status"]}
    rows = usable(statuses, repo)
    fresh = freshness(rows, at).first()
    plain = lambda df: [{k: v for k, v in r.asDict(True).items() if v is not None and k != "sort_at"} for r in df.collect()]
    return {
        "as_of": now, "needs_your_action": plain(needs_action(rows)), "your_prs_waiting": plain(waiting(rows)), "recent_issues": plain(recent_issues(status_issues(rows), at)),
        "team_activity": plain(team_activity(rows)), "stale_filtered": fresh.stale_filtered, "data_age_minutes": fresh.data_age_minutes,
        "warnings": [r.warning for r in warnings(statuses, repo).collect()],
    }
