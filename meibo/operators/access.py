"""Users' settings: the newest row of each, the one for an organization, defaults, and reports of logins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.text import browser_label, request_ip


def latest_per_user(df: DataFrame) -> DataFrame:
    """The newest row of each user that has a name, unknown times last; of equal times the greatest row."""
    rest = [c for c in df.columns if c not in ("user_id", "updated_at")]
    newest = F.max(F.struct(F.col("updated_at").isNotNull().alias("k"), "updated_at", *rest)).alias("r")
    rows = df.where(F.trim(F.coalesce("user_id", F.lit(""))) != "")
    return rows.groupBy("user_id").agg(newest).select("user_id", "r.updated_at", *[f"r.{c}" for c in rest]).select(*df.columns)


def settings_for_user(df: DataFrame, user: str, organization: str) -> DataFrame:
    """A user's row: one of the same organization goes first, then the newest."""
    own = df.where(F.col("user_id") == user)
    return own.orderBy((F.col("organization") == organization).desc_nulls_last(), F.col("updated_at").desc_nulls_last()).limit(1)


def user_settings_join(users: DataFrame, permissions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Users with their newest permissions and scope; the optimizer broadcasts what is small."""
    p = latest_per_user(permissions).select("user_id", "permissions")
    s = latest_per_user(scopes).select("user_id", "allowed_filters")
    return users.join(p, "user_id", "left").join(s, "user_id", "left")


def default_permissions(df: DataFrame, keys: list[str], column: str = "permissions") -> DataFrame:
    """A map with every key: absent and null ones are allowed, unknown ones are dropped."""
    own = F.coalesce(F.col(column), F.create_map().cast("map<string,boolean>"))
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(True)) for k in keys]))
    return df.withColumn(column, made)


def login_report(events: DataFrame, most: int = 50) -> DataFrame:
    """Logins with address and browser cleaned, the latest ``most`` of each user.

    The row number is limited before the shuffle, so each task sends ``most`` rows of a user at most.
    """
    rows = events.select("user_id", "logged_at", "event_id", request_ip("forwarded", "real_ip").alias("ip_address"), browser_label("agent").alias("browser"))
    order = Window.partitionBy("user_id").orderBy(F.col("logged_at").desc_nulls_last(), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
