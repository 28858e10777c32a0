"""The event log of runs: lanes, roll-ups, sweeps, intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelode.functions.scalars import java_trim, validate_url
from timelode.schemas import ERROR_CODES, EVENT_TYPES, PHASES, RUN_STATUSES, WORK_PHASES

LIVE = ("PENDING", "IN_PROGRESS")


def page_of(df: DataFrame, page: int, size: int, most: int, *order: Column) -> DataFrame:
    """One page of an ordered listing, each row with the `total` of the whole listing; a deep page sorts all that is before it.

    The total is a scalar subquery, so it is counted in the same job, and a page past the end has no row to tell it.
    """
    size = max(1, min(size, most))
    rows = df.orderBy(*order).offset(max(page, 0) * size).limit(size)
    return rows.withColumn("total", df.agg(F.count("*")).scalar())


def filter_events(events: DataFrame, run_id=None, event_type=None, status=None, phase=None, error_code=None, from_ts=None, to_ts=None, page: int | None = None, size: int = 100) -> DataFrame:
    """Events that meet all given conditions; a value outside its closed set meets none. Newest first, with the total, where paged."""
    found = events
    if run_id is not None:
        found = found.filter(F.col("run_id") == run_id)
    for name, value, allowed in (("event_type", event_type, EVENT_TYPES), ("status", status, RUN_STATUSES), ("phase", phase, PHASES), ("error_code", error_code, ERROR_CODES)):
        if value is not None:
            value = value if name == "event_type" else value.upper()
            found = found.filter(F.col(name) == value if value in allowed else F.lit(False))
    if from_ts is not None:
        found = found.filter(F.col("occurred_at") >= from_ts)
    if to_ts is not None:
        found = found.filter(F.col("occurred_at") < to_ts)
    return found if page is None else page_of(found, page, size, 500, F.desc("occurred_at"), F.desc("event_id"))


def item_events(events: DataFrame, item_id, page: int = 0, size: int = 100) -> DataFrame:
    return page_of(events.filter(F.col("item_id") == item_id), page, size, 500, F.asc("occurred_at"), F.asc("event_id"))


def run_events(events: DataFrame, run_id, page: int = 0, size: int = 100) -> DataFrame:
    return page_of(events.filter(F.col("run_id") == run_id), page, size, 500, F.asc("occurred_at"), F.asc("event_id"))


def event_tail(events: DataFrame, run_id, page_size: int = 500, max_pages: int = 4) -> DataFrame:
    """The newest whole pages of a run's feed in its ascending order: at most `max_pages` of them."""
    of_run = events.filter(F.col("run_id") == run_id)
    total = of_run.count()
    pages = -(-total // page_size)
    skip = max(0, pages - max_pages) * page_size
    newest = of_run.orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(total - skip)
    return newest.orderBy("occurred_at", "event_id")


def latest_attempt(items: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each item's latest attempt; a null attempt counts as the first."""
    attempt = F.coalesce("attempt", F.lit(1))
    seen = events.groupBy("item_id").agg(F.max(attempt).alias("seen"))
    latest = items.select("item_id", attempt.alias("own")).join(seen, "item_id", "left").select("item_id", F.greatest("own", F.coalesce("seen", F.lit(1))).alias("latest"))
    return events.join(latest, "item_id").filter(attempt == F.col("latest")).drop("latest")


def _index_of(phase: Column) -> Column:
    """Place among the work phases from 0; -1 for others."""
    return F.array_position(F.array(*map(F.lit, WORK_PHASES)), phase).cast("int") - 1


def phase_lanes(items: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """(item_id, phase_index, phase, state, millis): what became of each work phase in the latest attempt.

    Times are cut to whole milliseconds before they are subtracted.
    """
    ms = F.unix_millis(F.col("occurred_at").cast("timestamp"))
    of = latest_attempt(items, events)
    marks = of.groupBy("item_id", "phase").agg(
        F.min(F.when(F.col("event_type") == "ITEM_PHASE_ENTERED", ms)).alias("entered"),
        F.max(F.when(F.col("event_type") == "ITEM_PHASE_COMPLETED", ms)).alias("completed"),
    )
    entered = of.filter((F.col("event_type") == "ITEM_PHASE_ENTERED") & F.col("phase").isNotNull())
    last = entered.groupBy("item_id").agg(_index_of(F.max_by("phase", F.struct("occurred_at", "event_id"))).alias("last_entered"))
    failed = F.nullif(F.nullif(java_trim("failed_phase"), F.lit("")), F.lit("DONE"))
    live = F.col("status").isin(*LIVE)
    frontier = F.when(failed.isNotNull(), _index_of(failed)).when(live, F.coalesce("last_entered", F.lit(-1))).otherwise(len(WORK_PHASES) - 1)
    grid = items.join(last, "item_id", "left").select("item_id", "status", failed.alias("failed"), F.unix_millis(F.col("phase_updated_at").cast("timestamp")).alias("updated"), frontier.alias("frontier"), F.posexplode(F.array(*map(F.lit, WORK_PHASES))).alias("phase_index", "phase"))
    rows = grid.join(marks, ["item_id", "phase"], "left")
    live = F.col("status").isin(*LIVE)
    here = F.coalesce(F.col("phase") == F.col("failed"), F.lit(False))
    state = (
        F.when(F.col("entered").isNull(), F.when(F.col("phase_index") > F.col("frontier"), "pending").otherwise("skipped"))
        .when(F.col("completed").isNotNull(), "done")
        .when(live & ~here, "live")
        .when(F.col("status") == "CANCELLED", "cancelled")
        .otherwise("failed")
    )
    millis = F.when(state == "done", F.col("completed") - F.col("entered")).when(state.isin("failed", "cancelled"), F.col("updated") - F.col("entered")).when(state == "live", F.unix_millis(now.cast("timestamp")) - F.col("entered"))
    return rows.select("item_id", "phase_index", "phase", state.alias("state"), millis.alias("millis"))


def lane_summary(lanes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, total_millis, text, pending_runs): the lane in words, and the lengths of its runs of pending phases."""
    by_item = Window.partitionBy("item_id").orderBy("phase_index")
    pending = (F.col("state") == "pending").cast("int")
    marked = lanes.withColumn("p", pending).withColumn("island", F.sum(F.when(F.coalesce(F.lag("p").over(by_item), F.lit(-1)) != F.col("p"), 1).otherwise(0)).over(by_item))
    islands = marked.filter("p = 1").groupBy("item_id", "island").agg(F.count("*").alias("n"))
    runs = islands.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "n"))), lambda x: x["n"].cast("string")), ",").alias("pending_runs"))

    def first(states: tuple[str, ...], column: str = "phase") -> Column:
        return F.min_by(F.when(F.col("state").isin(*states), F.col(column)), F.when(F.col("state").isin(*states), F.col("phase_index")))

    sums = lanes.groupBy("item_id").agg(F.sum("millis").alias("total_millis"), first(("failed", "cancelled")).alias("broke"), first(("failed", "cancelled"), "state").alias("broke_state"), first(("live",)).alias("running"), F.every(F.col("state") == "pending").alias("dead"))
    found = items.select("item_id", "status").join(sums, "item_id").join(runs, "item_id", "left")
    text = (
        F.when(F.col("broke").isNotNull(), F.concat("broke_state", F.lit(" in "), F.col("broke")))
        .when(F.col("running").isNotNull(), F.concat(F.lit("running "), F.col("running")))
        .when(F.col("dead") & F.col("status").isin("FAILED", "CANCELLED"), F.concat(F.lower("status"), F.lit(" before any phase ran")))
        .when(F.col("status") == "PENDING", "not started")
        .otherwise("complete")
    )
    return found.select("item_id", F.coalesce("total_millis", F.lit(0)).alias("total_millis"), text.alias("text"), F.coalesce("pending_runs", F.lit("")).alias("pending_runs"))


def run_status(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with status, phase, error_code and error derived from their items; a run without items stays as it is."""
    def of_first(status: str, column: str) -> Column:
        hit = F.col("status") == status
        return F.min_by(F.when(hit, F.struct(column)), F.when(hit, F.struct("created_at", "item_id")))[column]

    of = items.groupBy("run_id").agg(
        F.bool_or(F.col("status").isin(*LIVE)).alias("live"), F.bool_or(F.col("status") == "FAILED").alias("failed"), F.every(F.col("status") == "CANCELLED").alias("cancelled"),
        *[of_first(s, c).alias(f"{s}_{c}") for s in ("FAILED", "CANCELLED") for c in ("error_code", "error")],
    )
    joined = runs.withColumnsRenamed({c: f"old_{c}" for c in ("status", "phase", "error_code", "error")}).join(of, "run_id", "left")
    none = F.col("live").isNull()
    status = F.when(none, F.col("old_status")).when(F.col("live"), "IN_PROGRESS").when(F.col("failed"), "FAILED").when(F.col("cancelled"), "CANCELLED").otherwise("COMPLETED")

    def error(c: str) -> Column:
        return F.when(none | F.col("live"), F.col(f"old_{c}")).when(F.col("failed"), F.col(f"FAILED_{c}")).when(F.col("cancelled"), F.col(f"CANCELLED_{c}"))

    phase = F.when(none | F.col("live"), F.col("old_phase")).otherwise("DONE")
    new = {"status": status, "phase": phase, "error_code": error("error_code"), "error": error("error")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in runs.columns])


def status_tally(items: DataFrame) -> DataFrame:
    """(status, n) in the order of the statuses, with ALL and IN_FLIGHT; statuses without items are left out."""
    total = items.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("status")).alias("status"), "n")
    flight = items.filter(F.col("status").isin(*LIVE)).groupBy().agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("IN_FLIGHT").alias("status"), "n")
    place = F.array_position(F.array(*map(F.lit, RUN_STATUSES)), F.col("status"))
    return total.unionByName(flight).orderBy(F.when(place > 0, place).otherwise(99), "status")


def phase_metrics(lanes: DataFrame) -> DataFrame:
    """Durations per phase and outcome."""
    return lanes.filter("millis IS NOT NULL").groupBy("phase", "state").agg(F.count("*").alias("n"), F.avg("millis").alias("avg_millis"), F.max("millis").alias("max_millis"))


def error_tally(items: DataFrame) -> DataFrame:
    """Failed and cancelled items per error code; a null code counts as NONE."""
    return items.filter(F.col("status").isin("FAILED", "CANCELLED")).groupBy("status", F.coalesce("error_code", F.lit("NONE")).alias("error_code")).agg(F.count("*").alias("n"))


def events_per_item_phase(events: DataFrame) -> DataFrame:
    return events.groupBy("item_id", "phase").agg(F.count("*").alias("n"))


def events_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))


def _leased(now: Column) -> Column:
    return F.col("lease_expires_at").isNotNull() & (F.col("lease_expires_at") > now)


def _replaced(items: DataFrame, changed: DataFrame) -> DataFrame:
    """All items of the runs that have a changed one, the changed ones as they are now."""
    touched = items.join(changed.select("run_id").distinct(), "run_id", "left_semi")
    return touched.join(changed.select("item_id"), "item_id", "left_anti").select(*items.columns).unionByName(changed.select(*items.columns))


def refreshed_runs(runs: DataFrame, items: DataFrame, changed: DataFrame) -> DataFrame:
    """The runs of the changed items, rolled up anew."""
    return run_status(runs.join(changed.select("run_id").distinct(), "run_id", "left_semi"), _replaced(items, changed)).select(*runs.columns)


def stuck_items(items: DataFrame, videos: DataFrame, runs: DataFrame, now: Column, stale_after: str = "1 hour") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, events, videos, runs) after the sweep: live items without news and lease are failed, their videos with them, and their runs rolled up anew."""
    stuck = items.filter(F.col("status").isin(*LIVE) & (F.col("phase_updated_at") < now - F.expr(f"INTERVAL {stale_after}")) & ~_leased(now))
    reason = F.concat(F.lit("no progress since "), F.date_format("phase_updated_at", "yyyy-MM-dd HH:mm:ss"))
    new = {"status": F.lit("FAILED"), "failed_phase": F.col("phase"), "phase": F.lit("DONE"), "error_code": F.lit("UNEXPECTED"), "error": reason, "phase_updated_at": now.cast(items.schema["phase_updated_at"].dataType)}
    failed = stuck.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])
    events = failed.select("item_id", "run_id", F.lit("ITEM_FAILED").alias("event_type"), F.coalesce("attempt", F.lit(1)).alias("attempt"), F.col("failed_phase").alias("phase"), "status", "error_code", now.alias("occurred_at"))
    ended = videos.join(failed.select("video_id").distinct(), "video_id", "left_semi").filter(~F.col("status").isin("COMPLETED", "FAILED")).withColumn("status", F.lit("FAILED"))
    return failed, events, ended, refreshed_runs(runs, items, failed)


def reconcile_runs(runs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Runs in progress, derived anew; those still in progress without a live lease on any item fail."""
    again = run_status(runs.filter("status = 'IN_PROGRESS'"), items)
    leased = items.filter(_leased(now)).select("run_id", F.lit(True).alias("leased")).distinct()
    dead = (F.col("status") == "IN_PROGRESS") & F.col("leased").isNull()
    joined = again.join(leased, "run_id", "left")
    return joined.select(*[(F.when(dead, F.lit({"status": "FAILED", "error_code": "UNEXPECTED"}[c])).otherwise(F.col(c)).alias(c) if c in ("status", "error_code") else F.col(c)) for c in runs.columns])


def retry_eligibility(runs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """(item_id, accepted, reason, attempt, previous_error_code) for the items of failed runs."""
    of = items.join(runs.filter("status = 'FAILED'").select("run_id"), "run_id", "left_semi")
    reason = F.when(F.col("status") == "COMPLETED", "item is completed").when(F.col("status") == "CANCELLED", "item is cancelled").when(_leased(now), "item is leased")
    attempt = F.coalesce("attempt", F.lit(1)) + F.when(reason.isNull(), 1).otherwise(0)
    return of.select("run_id", "item_id", reason.isNull().alias("accepted"), reason.alias("reason"), attempt.alias("attempt"), F.when(reason.isNull(), F.col("error_code")).alias("previous_error_code"))


def retry_items(runs: DataFrame, items: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, events, runs) after a retry of what is eligible: a further attempt from the start, without errors and video.

    The event of each item tells the phase and the error of the failure before; the runs are rolled up anew.
    """
    verdict = retry_eligibility(runs, items, now).filter("accepted").select("item_id", F.col("attempt").alias("_attempt"))
    old = items.join(verdict, "item_id")
    failed_phase = F.coalesce(*[F.col(c) for c in ("failed_phase", "phase") if c in items.columns])
    events = old.select("item_id", "run_id", F.lit("ITEM_RETRY_REQUESTED").alias("event_type"), F.col("_attempt").alias("attempt"), failed_phase.alias("phase"), F.lit("PENDING").alias("status"), "error_code", "error", now.alias("occurred_at"))
    new = {"attempt": F.col("_attempt"), "status": F.lit("PENDING"), "phase": F.lit("CREATED"), "phase_updated_at": now}
    cleared = ("failed_phase", "error_code", "error", "video_id")
    changed = old.select(*[(F.lit(None) if c in cleared else new.get(c, F.col(c))).cast(items.schema[c].dataType).alias(c) for c in items.columns])
    return changed, events, refreshed_runs(runs, items, changed)


def intake_urls(requests: DataFrame) -> DataFrame:
    """(req_id, pos, url, verdict): per request in its order, bad URLs and later copies are refused."""
    trimmed = requests.withColumn("url", java_trim("url")).withColumn("bad", validate_url("url"))
    copy = F.row_number().over(Window.partitionBy("req_id", "url").orderBy("pos"))
    return trimmed.withColumn("n", copy).select("req_id", "pos", "url", F.coalesce("bad", F.when(F.col("n") > 1, "duplicate url in request"), F.lit("ACCEPTED")).alias("verdict"))


def intake_items(verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items, events) of the accepted URLs; a request without any gets no run."""
    items = verdicts.filter("verdict = 'ACCEPTED'").select(
        F.concat_ws("-", "req_id", "pos").alias("item_id"), F.col("req_id").cast("string").alias("run_id"), "url", F.lit("PENDING").alias("status"), F.lit("CREATED").alias("phase"), F.lit(1).alias("attempt"), now.alias("created_at")
    )
    events = items.select("item_id", "run_id", F.lit("ITEM_CREATED").alias("event_type"), "phase", "status", "attempt", F.col("created_at").alias("occurred_at"))
    return items, events


def items_from_events(events: DataFrame) -> DataFrame:
    """The newest state of every item, folded from its events in one aggregate with a rule for each field.

    The newest event tells run, status, phase and attempt. The video is that of the newest ITEM_VIDEO_ATTACHED since the
    last retry. The error is that of the newest failure or cancellation; a later retry or any sign of further work clears it.
    Columns video_id, error_code and error of the events are optional; what is absent stays null.
    """
    named = events.select("*", *[F.lit(None).cast("string").alias(c) for c in ("video_id", "error_code", "error") if c not in events.columns])
    order, kind = F.struct("occurred_at", "event_id"), F.col("event_type")

    def newest(value: Column, when: Column | None = None) -> Column:
        return F.max_by(value, order) if when is None else F.max_by(F.when(when, value), F.when(when, order))

    found = named.groupBy("item_id").agg(
        newest(F.struct("run_id", "event_type", "phase", F.coalesce("attempt", F.lit(1)).alias("attempt"), "occurred_at", "error_code", "error")).alias("e"),
        newest(F.struct("video_id", order.alias("at")), kind == "ITEM_VIDEO_ATTACHED").alias("v"), F.max(F.when(kind == "ITEM_RETRY_REQUESTED", order)).alias("retried"),
    )
    kind = F.col("e.event_type")
    status = F.when(kind == "ITEM_COMPLETED", "COMPLETED").when(kind == "ITEM_FAILED", "FAILED").when(kind == "ITEM_CANCELLED", "CANCELLED").when(kind.isin("ITEM_CREATED", "ITEM_RETRY_REQUESTED"), "PENDING").otherwise("IN_PROGRESS")
    ended, broke = status.isin("COMPLETED", "FAILED", "CANCELLED"), status.isin("FAILED", "CANCELLED")
    phase = F.when(ended, "DONE").when(kind.isin("ITEM_CREATED", "ITEM_RETRY_REQUESTED"), "CREATED").otherwise(F.col("e.phase"))
    video = F.when(F.col("retried").isNull() | (F.col("v.at") > F.col("retried")), F.col("v.video_id"))
    return found.select(
        "item_id", F.col("e.run_id").alias("run_id"), video.alias("video_id"), status.alias("status"), phase.alias("phase"), F.when(broke, F.col("e.phase")).alias("failed_phase"), F.col("e.attempt").alias("attempt"),
        F.when(broke, F.col("e.error_code")).alias("error_code"), F.when(broke, F.col("e.error")).alias("error"), F.col("e.occurred_at").alias("phase_updated_at"),
    )
