"""Jobs of sessions: latest wins, cancellation, throttling, the reducer, retention, chunked files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUSY = ("loading-image", "loading-model", "processing")


def latest_only(jobs: DataFrame) -> DataFrame:
    """Rows of each session's latest job. The latest job of a session is aggregated before it moves; the join may be split on a hot session."""
    last = jobs.groupBy("session").agg(F.max("job").alias("last"))
    return jobs.join(last, "session").where("job = last").drop("last")


def with_latest(jobs: DataFrame) -> DataFrame:
    """Every row, with stale = it is of a job that a later one of the session has replaced."""
    last = jobs.groupBy("session").agg(F.max("job").alias("last"))
    return jobs.join(last, "session").withColumn("stale", F.col("job") < F.col("last")).drop("last")


def without_cancelled(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    return jobs.join(cancelled.select("job").distinct(), "job", "left_anti")


def throttled(progress: DataFrame, least_ms: int = 100) -> DataFrame:
    """Of (session, phase, at, loaded, total): what is reported. A fold, as it depends on what was reported before.

    A row passes if its phase is new, the last report is least_ms old, or it is the
    end. One session's rows meet in one array, which is as long as one download's
    reports.
    """
    row = F.struct("at", "phase", "loaded", "total")
    ordered = progress.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "array<struct<at:bigint,phase:string,loaded:double,total:double>>"
    start = F.array().cast(kind)
    last = lambda kept: F.try_element_at(kept, F.lit(-1))
    skip = lambda kept, r: F.coalesce((r["phase"] == last(kept)["phase"]) & (r["at"] - last(kept)["at"] < least_ms) & (r["loaded"] < r["total"]), F.lit(False))
    kept = F.aggregate("rows", start, lambda kept, r: F.when(skip(kept, r), kept).otherwise(F.concat(kept, F.array(r).cast(kind))))
    return ordered.select("session", F.explode(kept).alias("r")).select("session", "r.*")


def serial(jobs: DataFrame) -> DataFrame:
    """When jobs (session, job, arrival, work) run if each session does one at a time, by arrival and job: also started and finished.

    A job finishes with all work up to it, after the latest of the arrivals that had
    to wait for nothing: the running maximum of arrival less the work before it. So
    running sums and maxima do, and the planner may split nothing but sessions.
    """
    order = Window.partitionBy("session").orderBy("arrival", "job").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = jobs.withColumn("_done", F.sum("work").over(order))
    idle = F.max(F.col("arrival") - (F.col("_done") - F.col("work"))).over(order)
    finished = done.withColumn("finished", F.col("_done") + idle)
    return finished.withColumn("started", F.col("finished") - F.col("work")).drop("_done")


def download_progress(pieces: DataFrame, key: str) -> DataFrame:
    """Rows of a byte stream's progress: key, idx, loaded, percent, for the parts (idx, size) at which the whole percentage changes."""
    whole = Window.partitionBy(key)
    so_far = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.select(key, "idx", F.sum("size").over(so_far).cast("long").alias("loaded"), F.sum("size").over(whole).alias("_total"))
    rows = rows.withColumn("percent", F.least(F.lit(100), F.floor(F.try_divide(F.col("loaded") * 100, F.col("_total")))).cast("int"))
    return changes(rows, key, ["idx"], F.col("percent")).drop("_total")


def changes(rows: DataFrame, by: str, order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the one before; the first counts unless it is null."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col("_before").eqNullSafe(value)).drop("_before")


STATE = "struct<view:string,job:bigint,stage:string,png:boolean,model:string,fell_back:boolean>"


def start_state() -> Column:
    return F.struct(F.lit("idle").alias("view"), F.lit(None).cast("bigint").alias("job"), F.lit(None).cast("string").alias("stage"), F.lit(False).alias("png"), F.lit("unknown").alias("model"), F.lit(False).alias("fell_back")).cast(STATE)


def is_current(s: Column, e: Column) -> Column:
    """Whether event e is of the job on screen."""
    return s["job"].eqNullSafe(e["job"]) & e["job"].isNotNull()


def reduced(s: Column, e: Column) -> Column:
    """The state after event e (type, job, stage). What does not fit the state changes nothing."""
    kind = e["type"]
    busy, current = s["view"].isin(*BUSY), is_current(s, e)

    def state(view=None, job=None, stage=None, png=None, model=None, fell=None) -> Column:
        null = lambda t: F.lit(None).cast(t)
        gone = view is not None
        return F.struct(
            (F.lit(view) if isinstance(view, str) else view if gone else s["view"]).alias("view"),
            (job if job is not None else null("bigint") if gone else s["job"]).alias("job"),
            (stage if stage is not None else null("string") if gone else s["stage"]).alias("stage"),
            (png if png is not None else F.lit(False) if gone else s["png"]).alias("png"),
            (F.lit(model) if isinstance(model, str) else s["model"] if model is None else model).alias("model"),
            (F.lit(True) if fell else s["fell_back"]).alias("fell_back"),
        ).cast(STATE)

    step = F.when(e["stage"] == "decoding", "loading-image").when(e["stage"] == "waiting-for-model", "loading-model").otherwise("processing")
    return (
        F.when(kind == "select", state("loading-image", e["job"]))
        .when(kind == "reject", state("error"))
        .when((kind == "stage") & current & busy, state(step, s["job"], F.when(step == "processing", e["stage"])))
        .when((kind == "preview") & current & busy, state("complete", s["job"]))
        .when((kind == "png") & current & (s["view"] == "complete"), state(png=F.lit(True)))
        .when((kind == "job-error") & current, state("error", s["job"]))
        .when((kind == "cancel") & current & busy, state("cancelled"))
        .when(kind == "reset", state("idle"))
        .when((kind == "model-progress") & (s["model"] != "ready"), state(model="loading"))
        .when(kind == "model-ready", state(model="ready"))
        .when((kind == "model-error") & busy, state("error", s["job"], model="error"))
        .when(kind == "model-error", state(model="error"))
        .when(kind == "fallback", state(fell=True))
        .otherwise(s)
    )


def folded(events: DataFrame, by: str, order: str) -> DataFrame:
    """The last state of each log: events (by, order, type, job, stage)."""
    row = F.struct(F.col(order).alias("at"), "type", "job", "stage")
    logs = events.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_log"))
    return logs.select(by, F.aggregate("_log", start_state(), reduced).alias("state"))


COMMANDED = "struct<job:bigint,busy:boolean,chosen:boolean,cancelled:bigint>"


def commanded(commands: DataFrame) -> DataFrame:
    """Of (session, job, command): session, job on screen, busy, and cancelled: how many running jobs commands ended.

    start takes a new image and supersedes what runs; retry does so with the image
    there is; cancel ends what runs; start-over also forgets the image; done is the
    worker's. A fold, by job.
    """
    ordered = commands.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("job", "command"))).alias("log"))
    start = F.struct(F.lit(None).cast("bigint").alias("job"), F.lit(False).alias("busy"), F.lit(False).alias("chosen"), F.lit(0).cast("bigint").alias("cancelled")).cast(COMMANDED)

    def step(s: Column, e: Column) -> Column:
        kind = e["command"]
        starts = (kind == "start") | ((kind == "retry") & s["chosen"])
        ends = s["busy"] & (starts | kind.isin("cancel", "start-over"))
        return F.struct(
            F.when(starts, e["job"]).when((kind == "start-over") | ((kind == "cancel") & s["busy"]), F.lit(None)).otherwise(s["job"]).alias("job"),
            F.when(starts, True).when(kind.isin("start-over", "cancel", "done"), False).otherwise(s["busy"]).alias("busy"),
            F.when(kind == "start", True).when(kind == "start-over", False).otherwise(s["chosen"]).alias("chosen"),
            (s["cancelled"] + ends.cast("bigint")).alias("cancelled"),
        ).cast(COMMANDED)

    end = ordered.select("session", F.aggregate("log", start, step).alias("s"))
    return end.select("session", "s.job", "s.busy", "s.cancelled")


def activity(view: Column, model: Column) -> Column:
    """image, model or null: the heavy work that is going on."""
    return F.when(view.isin(*BUSY), "image").when(model == "loading", "model")


def newest(history: DataFrame, now: Column, most: int = 12, days: int = 30) -> DataFrame:
    """Entries that stay: of each owner the newest `most`, none strictly older than `days`. Ties go to the larger id.

    The rank limit is pushed below the shuffle (window group limit).
    """
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("created"), F.desc("id")))
    return history.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("created") >= now - F.expr(f"interval {days} days"))


def upserted(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History with changes of the same (owner, id) in their place."""
    return history.join(changes.select("owner", "id"), ["owner", "id"], "left_anti").unionByName(changes)


def parts(files: DataFrame, key: str, size: int) -> DataFrame:
    """Fixed-size parts of content: key, idx, part, size, sha256; an empty file has one empty part."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    cut = files.select(key, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"))
    part = F.substring(F.col("content"), F.col("idx") * size + 1, F.lit(size))
    return cut.select(key, "idx", part.alias("part")).withColumn("size", F.octet_length("part")).withColumn("sha256", F.sha2("part", 256))


def joined_parts(pieces: DataFrame, key: str) -> DataFrame:
    """key, content: parts put together in order."""
    ordered = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", F.hex("part").alias("h")))).alias("all"))
    return ordered.select(key, F.unhex(F.array_join(F.transform("all", lambda x: x["h"]), "")).alias("content"))


def cached_parts(pieces: DataFrame, cache: DataFrame) -> DataFrame:
    """Parts with hit: the cache has one of this digest and size."""
    have = cache.select("sha256", F.col("size").alias("_size")).distinct()
    return pieces.join(have, "sha256", "left").withColumn("hit", F.coalesce(F.col("_size") == F.col("size"), F.lit(False))).drop("_size")
