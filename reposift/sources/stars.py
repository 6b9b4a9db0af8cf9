"""Reading star envelopes and validating rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift import schemas
from reposift.sources.tables import Snapshots as Snapshots  # noqa: PLC0414  the name that jobs and callers use


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ENVELOPE).json(path)


def parse_envelopes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Envelope columns of JSON texts; a text that is no envelope gives nulls."""
    return lines.select(F.from_json(value, schemas.ENVELOPE).alias("e")).select("e.*")


def flatten(envelopes: DataFrame, fetched_at: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Star rows with upstream columns from the envelopes and local columns at their defaults, after the kept columns.

    Timestamps that do not parse become null, which validation then reports.
    """
    repo = F.col("repo")
    upstream = envelopes.select(
        *keep,
        F.lit(1).alias("schema_version"),
        repo["id"].alias("id"),
        repo["full_name"].alias("full_name"),
        repo["html_url"].alias("html_url"),
        repo["owner"]["login"].alias("owner_login"),
        repo["owner"]["avatar_url"].alias("owner_avatar_url"),
        repo["description"].alias("description"),
        F.coalesce(repo["topics"], F.array().cast("array<string>")).alias("topics"),
        repo["language"].alias("language"),
        F.try_to_timestamp("starred_at").alias("starred_at"),
        F.try_to_timestamp(repo["pushed_at"]).alias("pushed_at"),
        repo["stargazers_count"].alias("stargazers_count"),
        F.coalesce(repo["default_branch"], F.lit("main")).alias("default_branch"),
        F.coalesce(repo["archived"], F.lit(False)).alias("archived"),
        F.coalesce(repo["fork"], F.lit(False)).alias("is_fork"),
        fetched_at.alias("last_synced_at"),
    )
    return schemas.with_defaults(upstream).select(*keep, *schemas.STAR.names)


def _is_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def star_rules() -> dict[str, Column]:
    """Each rule's name and whether a row keeps it."""
    c = F.col
    return {
        "schema_version": c("schema_version") == 1,
        "id": c("id") > 0,
        "full_name": F.length("full_name") >= 3,
        "html_url": _is_url(c("html_url")),
        "owner_login": c("owner_login").isNotNull(),
        "owner_avatar_url": c("owner_avatar_url").isNull() | _is_url(c("owner_avatar_url")),
        "topics": c("topics").isNotNull() & ~F.exists("topics", lambda x: x.isNull()),
        "starred_at": c("starred_at").isNotNull(),
        "stargazers_count": c("stargazers_count") >= 0,
        "last_synced_at": c("last_synced_at").isNotNull(),
    }


def cursor_rules() -> dict[str, Column]:
    return {"known_count": F.col("known_count") >= 0, "updated_at": F.col("updated_at").isNotNull()}


def tag_rules() -> dict[str, Column]:
    return {
        "name": F.length("name").between(1, 64),
        "color": F.col("color").isNull() | F.col("color").rlike(r"^#[0-9a-fA-F]{6}\z"),
    }


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that gives null is broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def validate(rows: DataFrame, rules: dict[str, Column], failfast: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the array of broken rules; with failfast a broken row fails the job instead."""
    checked = rows.withColumn("violations", violations(rules))
    if failfast:
        message = F.concat(F.lit("invalid row: "), F.array_join("violations", ", "))
        good = checked.where(F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        return good.drop("violations"), checked.limit(0)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
