"""Who may see what, how deliveries and keys fare, and whose names resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import digest, full_name, full_name_valid, handle, handle_valid

VIEW, OWNER_ONLY = "view", "owner"


def accessible_repositories(repositories: DataFrame, memberships: DataFrame, user_id: int) -> DataFrame:
    """Repositories that the user owns or is a member of, with the role."""
    mine = memberships.filter(F.col("user_id") == user_id).select(F.col("repository_id").alias("id"), F.lit(True).alias("is_member")).distinct()
    rows = repositories.join(mine, "id", "left")
    owner = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    return rows.withColumn("role", F.when(owner, "owner").when(F.col("is_member"), "member")).filter("role is not null").drop("is_member")


def capabilities(repositories: DataFrame, memberships: DataFrame, user_id: int, permission: str) -> DataFrame:
    """Repositories where the user holds a permission: owners hold all, ``view`` follows from membership, ``owner`` from nothing else."""
    granted = memberships.filter(F.col("user_id") == user_id).select(F.col("repository_id").alias("id"), "permissions")
    rows = repositories.join(granted, "id", "left")
    owner = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    member = F.col("permissions").isNotNull()
    if permission == OWNER_ONLY:
        held = owner
    elif permission == VIEW:
        held = owner | member
    else:
        held = owner | F.coalesce(F.array_contains("permissions", permission), F.lit(False))
    return rows.filter(held).drop("permissions")


def members(memberships: DataFrame, users: DataFrame, repository_id: int) -> DataFrame:
    rows = memberships.filter(F.col("repository_id") == repository_id).select("user_id", "permissions")
    return rows.join(users, "user_id").orderBy("handle", "user_id")


def shared_permissions(memberships: DataFrame, user_id: int) -> DataFrame:
    return memberships.filter(F.col("user_id") == user_id).groupBy("repository_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("permissions")))).alias("permissions"))


def keys_minted_by(keys: DataFrame, repository_id: int) -> DataFrame:
    return keys.filter(F.col("repository_id") == repository_id).groupBy("user_id").agg(F.count(F.lit(1)).alias("key_count"))


def credential_health(keys: DataFrame) -> DataFrame:
    """Keys that were rotated and not used since."""
    stale = F.col("rotated_at").isNotNull() & (F.col("last_used_at").isNull() | (F.col("last_used_at") <= F.col("rotated_at")))
    return keys.withColumn("rotated_and_unused", stale)


def delivery_health(rejections: DataFrame, runs: DataFrame, limit: int = 10) -> DataFrame:
    """By repository: rejections shown (up to the limit), whether there are more, and whether it is refusing now."""
    last = rejections.groupBy("repository_id").agg(F.max("occurred_at").alias("last_rejection_at"), F.count(F.lit(1)).alias("n"))
    accepted = runs.groupBy("repository_id").agg(F.max("created_at").alias("last_accepted_run_at"))
    rows = last.join(accepted, "repository_id", "left")
    refusing = F.col("last_accepted_run_at").isNull() | (F.col("last_rejection_at") > F.col("last_accepted_run_at"))
    return rows.select("repository_id", "last_rejection_at", "last_accepted_run_at", F.least("n", F.lit(limit)).alias("shown_count"), (F.col("n") > limit).alias("bounded"), refusing.alias("refusing"))


def resolve_handles(asked: DataFrame, users: DataFrame) -> DataFrame:
    """For each ``asked`` handle: malformed, not_found, archived, found or ambiguous, and how many users match."""
    rows = asked.withColumn("normalized", handle(F.col("asked")))
    known = users.groupBy(F.col("handle").alias("normalized")).agg(
        F.count_if(F.col("archived_at").isNull()).alias("active"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"), F.min(F.when(F.col("archived_at").isNull(), F.col("user_id"))).alias("user_id")
    )
    rows = rows.join(known, "normalized", "left")
    good = F.coalesce(handle_valid(F.col("normalized")), F.lit(False))
    status = F.when(~good, "malformed").when(F.col("active") > 1, "ambiguous").when(F.col("active") == 1, "found").when(F.col("archived") > 0, "archived").otherwise("not_found")
    matches = F.when(status == "archived", F.col("archived")).otherwise(F.coalesce("active", F.lit(0)))
    return rows.select("asked", status.alias("status"), F.when(status == "found", F.col("user_id")).alias("user_id"), F.when(good, matches).otherwise(0).alias("match_count"))


def organizations(listing: DataFrame) -> DataFrame:
    """Owners that are organizations with at least one administered repository, by login."""
    rows = listing.filter("is_organization").groupBy("owner").agg(F.count(F.lit(1)).alias("repository_count"), F.count_if("is_admin").alias("administered_count"))
    return rows.filter("administered_count > 0").orderBy(F.lower("owner"))


def listing_verdicts(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Each asked full name against a listing, without case: administered, visible or absent; of equal names an administered one counts."""
    best = listing.groupBy(F.lower("full_name").alias("key")).agg(F.bool_or("is_admin").alias("is_admin"))
    rows = names.withColumn("key", F.lower("full_name")).join(best, "key", "left").drop("key")
    return rows.withColumn("verdict", F.when(F.col("is_admin"), "administered").when(F.col("is_admin").isNotNull(), "visible").otherwise("absent"))


def registration_candidates(names: DataFrame, registered: DataFrame) -> DataFrame:
    """Names to register, in order: the first of each name without case, split into new and already registered."""
    first = names.groupBy(F.lower("full_name").alias("key")).agg(F.min(F.struct("position", "full_name")).alias("row"))
    known = registered.select(F.lower("full_name").alias("key"), F.lit(True).alias("known")).distinct()
    rows = first.join(known, "key", "left")
    return rows.select(F.col("row.position").alias("position"), F.col("row.full_name").alias("full_name"), F.when(F.col("known"), "already_registered").otherwise("new").alias("group")).orderBy("position")


#: Why a name was not registered, in the order in which the groups are listed.
SKIP_ORDER = ["already_registered", "not_administered", "not_in_installation", "invalid", "not_installed", "not_authorized", "rate_limited", "unavailable"]


def bulk_registration(names: DataFrame, registered: DataFrame, listing: DataFrame) -> DataFrame:
    """What becomes of each asked name (position, full_name): registered, or why not; blank names and repeats, without case, go.

    A name that is taken is told before one that is malformed; the others are judged by the listing.
    """
    asked = names.withColumn("full_name", full_name(F.col("full_name"))).filter("full_name is not null")
    rows = registration_candidates(asked, registered)
    rows = listing_verdicts(rows, listing)
    good = full_name_valid(F.col("full_name"))
    status = (
        F.when(F.col("group") == "already_registered", "already_registered")
        .when(~good, "invalid")
        .when(F.col("verdict") == "administered", "registered")
        .when(F.col("verdict") == "visible", "not_administered")
        .otherwise("not_in_installation")
    )
    return rows.select("position", "full_name", status.alias("status"))


def skipped_groups(outcomes: DataFrame) -> DataFrame:
    """The names that were not registered, by reason: the reasons in their fixed order, the names as they were asked for."""
    place = F.array_position(F.array(*map(F.lit, SKIP_ORDER)), F.col("status")).cast("int")
    rows = outcomes.filter("status <> 'registered'").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("position", "full_name"))).alias("rows"))
    return rows.select(place.alias("place"), "status", "n", F.col("rows.full_name").alias("full_names")).orderBy("place")


def authenticated(tokens: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Each presented token with the active user whose key has its digest; NULL where there is none, or no token."""
    known = keys.join(users.filter("archived_at is null").select("user_id"), "user_id").select("token_digest", "user_id")
    return tokens.withColumn("token_digest", F.when(F.trim("token") != "", digest(F.col("token")))).join(known, "token_digest", "left").drop("token_digest")
