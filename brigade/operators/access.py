"""Who manages which restaurant: scope joins, gaps, counts and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brigade.operators.spread import paged_list, top_within

REGIONAL, MANAGER = "regional_manager", "restaurant_manager"


def staff_of(restaurants: DataFrame, labor: DataFrame) -> DataFrame:
    """Distinct staff per restaurant: one row per name and position, the lowest id first."""
    named = labor.where(F.col("name").isNotNull())
    per = named.groupBy("location_id", "name", "position").agg(F.min("employee_id").alias("employee_id"))
    r = restaurants.select(F.col("id").alias("location_id"), F.col("name").alias("restaurant_name"))
    return r.join(per, "location_id")


def scope_of(managers: DataFrame, assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Restaurants a manager may see."""
    r = restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), "active")
    m = managers.select(F.col("id").alias("manager_id"), "email", "role")
    return m.join(assignments, "manager_id").join(r, "restaurant_id")


def managers_with_superior(managers: DataFrame, assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Managers with their regional manager and active restaurants; those without any stay."""
    sup = managers.select(F.col("id").alias("regional_manager_id"), F.col("email").alias("regional_email"))
    active = restaurants.where("active").select(
        F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name")
    )
    a = assignments.select(F.col("manager_id").alias("id"), "restaurant_id")
    return (
        managers.select("id", "email", "role", "regional_manager_id")
        .join(sup, "regional_manager_id", "left")
        .join(a, "id", "left")
        .join(active, "restaurant_id", "left")
        .select("id", "email", "role", "regional_email", "restaurant_name")
    )


def inactive_restaurants(restaurants: DataFrame, managers: DataFrame) -> DataFrame:
    creator = managers.select(F.col("id").alias("created_by"), F.col("email").alias("creator_email"))
    closer = managers.select(F.col("id").alias("deactivated_by"), F.col("email").alias("deactivator_email"))
    return (
        restaurants.where(~F.col("active"))
        .join(creator, "created_by", "left")
        .join(closer, "deactivated_by", "left")
        .select("id", "name", "creator_email", "deactivator_email")
    )


def unassigned(restaurants: DataFrame, assignments: DataFrame) -> DataFrame:
    a = assignments.select(F.col("restaurant_id").alias("id"))
    return restaurants.where("active").join(a, "id", "left_anti").select("id", "name")


def _restaurants_of_role(assignments: DataFrame, managers: DataFrame, role: str) -> DataFrame:
    of_role = managers.where(F.col("role") == role).select(F.col("id").alias("manager_id"))
    return assignments.join(of_role, "manager_id").select(F.col("restaurant_id").alias("id"))


def regional_without_manager(
    restaurants: DataFrame, assignments: DataFrame, managers: DataFrame, regional_id: int | None = None
) -> DataFrame:
    """Active restaurants under a regional manager (one, or any) that have no restaurant manager."""
    regional = managers.where(F.col("role") == REGIONAL)
    if regional_id is not None:
        regional = regional.where(F.col("id") == regional_id)
    mine = assignments.join(regional.select(F.col("id").alias("manager_id")), "manager_id").select(
        F.col("restaurant_id").alias("id")
    )
    return (
        restaurants.where("active")
        .join(mine, "id", "left_semi")
        .join(_restaurants_of_role(assignments, managers, MANAGER), "id", "left_anti")
        .select("id", "name")
    )


def without_role(restaurants: DataFrame, assignments: DataFrame, managers: DataFrame, role: str) -> DataFrame:
    return (
        restaurants.where("active")
        .join(_restaurants_of_role(assignments, managers, role), "id", "left_anti")
        .select("id", "name")
    )


def latest_document(restaurants: DataFrame, documents: DataFrame) -> DataFrame:
    """Every restaurant with its newest stored KPI document, if any."""
    newest = documents.groupBy("location_id").agg(
        F.max_by(F.struct("document", "created_at"), "created_at").alias("_d")
    )
    r = restaurants.select(F.col("id").alias("location_id"), "name")
    return r.join(newest, "location_id", "left").select(
        "location_id", "name", F.col("_d.document").alias("document"), F.col("_d.created_at").alias("created_at")
    )


def store_ids(restaurants: DataFrame, names: DataFrame) -> DataFrame:
    """Asked names with the store id of the active restaurant; null when it is no POS store."""
    stores = restaurants.where("active").select("name", "store_id")
    return names.join(stores, "name", "left").withColumn("is_store", F.col("store_id").isNotNull())


def manager_counts(restaurants: DataFrame, assignments: DataFrame) -> DataFrame:
    a = assignments.groupBy(F.col("restaurant_id").alias("id")).agg(F.count(F.lit(1)).alias("managers"))
    return restaurants.select("id", "name").join(a, "id", "left").fillna(0, ["managers"])


def restaurants_per_manager(managers: DataFrame, assignments: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Distinct active restaurant names per manager as paged text; a manager without any gets ''."""
    r = restaurants.where("active").select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"))
    pairs = assignments.join(r, "restaurant_id").select(
        F.col("manager_id").alias("id"), "restaurant_name"
    ).distinct()
    pages = paged_list(pairs, ["id"], "restaurant_name", "restaurants")
    return managers.select("id", "email").join(pages, "id", "left").fillna({"page": 0, "restaurants": ""})


def role_counts(labor: DataFrame) -> DataFrame:
    return labor.groupBy("location_id", "position").agg(F.count_distinct("name").alias("staff"))


def affected_emails(restaurants: DataFrame, assignments: DataFrame, managers: DataFrame) -> DataFrame:
    """Distinct manager e-mails per restaurant, their own and their regional manager's: one row each."""
    m = managers.select(F.col("id").alias("manager_id"), "email", "regional_manager_id")
    sup = managers.select(F.col("id").alias("regional_manager_id"), F.col("email").alias("regional_email"))
    r = restaurants.select(F.col("id").alias("restaurant_id"))
    joined = r.join(assignments, "restaurant_id", "left").join(m, "manager_id", "left").join(
        sup, "regional_manager_id", "left")
    return joined.select(
        "restaurant_id", F.explode(F.array("email", "regional_email")).alias("email")
    ).where(F.col("email").isNotNull()).distinct()


def staff_directory(restaurants: DataFrame, labor: DataFrame) -> DataFrame:
    """Staff names per restaurant and position as paged text."""
    staff = staff_of(restaurants, labor).select("restaurant_name", "position", "name").distinct()
    return paged_list(staff, ["restaurant_name", "position"], "name", "names")


def newest_per_owner(df: DataFrame, owner: str, at: str) -> DataFrame:
    """Latest row of each owner."""
    return top_within(df, [owner], [F.col(at).desc(), F.struct(*[c for c in df.columns if c not in (owner, at)]).desc()], 1).drop("rank")


def one_per_id(managers: DataFrame) -> DataFrame:
    """One row per manager id: the smallest one."""
    rest = [c for c in managers.columns if c != "id"]
    return managers.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", "_r.*")


def notification_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if("is_read").alias("read"),
    )
