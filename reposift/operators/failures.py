"""Outcomes of model and service calls, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of failure that another try may mend.
TRANSIENT = ("rate_limit", "timeout", "server", "network", "parse")
# Milliseconds before each further try.
BACKOFF_MS = (500, 1500, 3500)
#: Largest wait, in seconds, that a service may ask for.
LONGEST_HINT = 30


def model_outcome(status: Column) -> Column:
    """Kind of failure of a model call by its HTTP status; null for success."""
    return (
        F.when(status < 400, F.lit(None).cast("string"))
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when(status.isin(408, 504), "timeout")
        .when(status.isin(400, 404, 413, 422), "bad_request")
        .when(status >= 500, "server")
        .otherwise("unknown")
    )


def host_outcome(status: Column, remaining: Column) -> Column:
    """Kind of failure of a call to the code host; 403 with no calls remaining is a rate limit."""
    return (
        F.when(status < 400, F.lit(None).cast("string"))
        .when(status == 401, "auth")
        .when((status == 403) & F.coalesce(remaining == 0, F.lit(False)), "rate_limit")
        .when(status == 403, "auth")
        .when(status == 429, "rate_limit")
        .when(status == 404, "not_found")
        .when(status == 422, "validation")
        .when(status >= 500, "server")
        .otherwise("unknown")
    )


def strongest(log: DataFrame, by: str, ord: str = "ord", kind: str = "kind", message: str = "message", weak: str = "weak") -> DataFrame:
    """(by, kind, message): each group's failure that counts.

    A typed failure (with kind) beats a plain one, and that a weak signal
    (weak is true); of typed and of plain ones the last counts, of weak ones
    the first. Only typed ones give a kind.
    """
    tier = F.when(F.col(kind).isNotNull(), 2).when(F.coalesce(F.col(weak), F.lit(False)), 0).otherwise(1)
    order = F.when(tier == 0, -F.col(ord)).otherwise(F.col(ord))
    best = log.groupBy(by).agg(F.max_by(F.struct(F.col(kind).alias("kind"), F.col(message).alias("message")), F.struct(tier, order)).alias("best"))
    return best.select(by, "best.kind", "best.message")


def run_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status and token sum of a run; the failed ids are failed_rows()."""
    done = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*(by or [])).agg(done("done").alias("done"), done("skipped").alias("skipped"), done("failed").alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def failed_rows(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, id): every failed id of a run, one row each."""
    return results.where(F.col("status") == "failed").select(*(by or []), "id")
