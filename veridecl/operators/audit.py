"""The audit log: events from requests, pages, trails and the append-only sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MUTATING = ("POST", "PUT", "PATCH", "DELETE")
EXCLUDED = ("/health", "/api/v1/auth/login", "/api/v1/auth/refresh", "/", "/openapi.json")


def audit_events(requests: DataFrame) -> DataFrame:
    """Requests that change something as audit events: action, entity and a JSON value."""
    path, method = F.col("path"), F.col("method")
    kept = method.isin(*MUTATING) & ~path.isin(*EXCLUDED) & ~path.startswith("/docs") & ~path.startswith("/redoc")
    parts = F.split(F.trim(path, F.lit("/")), "/")
    kind, known = F.get(parts, 2), F.size(parts) >= 4
    entity = F.when(known & (kind == "inspections"), F.when(F.get(parts, 4) == "images", "image").otherwise("inspection")).when(known & (kind == "rules"), "rule").when(known & (kind == "corrections"), "correction").otherwise("unknown")
    action = F.when(method == "POST", F.when(path.contains("/images"), "upload_image").otherwise("create")).when(method.isin("PUT", "PATCH"), "update").when(method == "DELETE", "delete").otherwise("unknown")
    rows = requests.filter(kept)
    return rows.select("event_id", "actor_id", action.alias("action"), entity.alias("entity_type"), F.when(entity == "unknown", "unknown").otherwise(F.get(parts, 3)).alias("entity_id"), F.to_json(F.struct("method", "path")).alias("after_value"), F.col("ts").alias("created_at"))


def actor_from_token(token: Column) -> Column:
    """The subject in the payload of a bearer token, unchecked; null if it can't be read."""
    parts = F.split(F.regexp_replace(token, r"^Bearer ", ""), r"\.")
    body = F.translate(F.get(parts, 1), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4)).cast("int")))
    text = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    return F.when(token.startswith("Bearer ") & (F.size(parts) == 3), F.get_json_object(text, "$.sub"))


def audit_filter(log: DataFrame, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Rows that equal all of actor_id, action, entity_type, entity_id given, in an inclusive range of time."""
    for column, value in equal.items():
        log = log.filter(F.col(column) == value)
    if since:
        log = log.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return log.filter(F.col("created_at") <= F.lit(until).cast("timestamp")) if until else log


def audit_page(log: DataFrame, page: int = 1, page_size: int = 20, **options) -> DataFrame:
    """A page, newest first, with the number of all rows that fit."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page from 1, page_size from 1 to 100")
    rows = audit_filter(log, **options)
    top = rows.orderBy(F.desc("created_at"), "event_id").offset((page - 1) * page_size).limit(page_size)
    return top.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def audit_by_id(log: DataFrame, event_id: int) -> DataFrame:
    return log.filter(F.col("event_id") == event_id)


def entity_trail(log: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """All events of one entity, oldest first."""
    return audit_filter(log, entity_type=entity_type, entity_id=entity_id).orderBy("created_at", "event_id")


def append_audit(events: DataFrame, path: str) -> None:
    """Appends; nothing here changes or removes rows."""
    events.write.mode("append").partitionBy().parquet(path)
