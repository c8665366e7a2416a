"""Work queues as pure functions: queue in, claimed jobs and queue out.

There are no row locks here: one writer at a time replaces the queue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.functions.classify import queue_state
from pricelode.functions.dates import backoff_minutes
from pricelode.functions.ids import gtin14
from pricelode.operators.history import first_by


def claim_order(priority: str, requested: str, tie: str) -> list[Column]:
    return [F.desc_nulls_last(priority), F.asc_nulls_first(requested), F.asc(tie)]


def claim(queue: DataFrame, job: str, state: str, ready: Column, order: list[Column], most: int, worker: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(the next ``most`` ready jobs, the queue with them in process)."""
    claimed = queue.where(ready).orderBy(*order).limit(most)
    mark = F.broadcast(claimed.select(job).withColumn("_mine", F.lit(True)))  # ``most`` rows at most
    after = queue.join(mark, job, "left").withColumn(state, F.when(F.col("_mine"), F.lit("processing")).otherwise(F.col(state)))
    after = after.withColumn("claimed_by", F.when(F.col("_mine"), F.lit(worker))).withColumn("claimed_at", F.when(F.col("_mine"), as_of)).drop("_mine")
    return claimed, after


def enqueue(queue: DataFrame, requests: DataFrame, job: str) -> DataFrame:
    """job, priority, state, request_count: requests (job, priority; several per job) join the
    queue; a job's priority only rises and a job in process stays so."""
    asked = requests.groupBy(job).agg(F.max("priority").alias("_p"), F.count("*").alias("_n"))
    both = queue.join(asked, job, "full")
    state = F.when(F.col("_n").isNull(), F.col("state")).otherwise(queue_state(F.col("state"), F.lit(1)))
    return both.select(
        job, F.greatest("priority", "_p").alias("priority"), F.coalesce(state, F.lit("queued")).alias("state"), (F.coalesce("request_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("request_count")
    )


def finish(queue: DataFrame, results: DataFrame, job: str, as_of: Column, most_attempts: int = 8) -> DataFrame:
    """The queue after results (job, ok, permanent): done, failed, or to be retried after a
    pause that doubles. Jobs without a result are untouched."""
    joined = queue.join(results, job, "left")
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(F.col("ok").isNull(), 0).otherwise(1)
    over = F.coalesce("permanent", F.lit(False)) | (attempts >= most_attempts)
    state = F.when(F.col("ok").isNull(), F.col("state")).when(F.col("ok"), F.lit("done")).when(over, F.lit("failed")).otherwise(F.lit("retry_later"))
    pause = F.make_interval(mins=backoff_minutes(attempts))
    again = F.when(state == "retry_later", as_of + pause).when(F.col("ok").isNull(), F.col("next_attempt_at"))
    return joined.select(*(c for c in queue.columns if c not in ("state", "attempts", "next_attempt_at")), state.alias("state"), attempts.alias("attempts"), again.alias("next_attempt_at"))


#: Rows of a range that is numbered in one task, about.
RANGE_ROWS = 100_000


def _range_of(key: str, cuts: list[float]) -> Column:
    return F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)


def from_position(items: DataFrame, key: str, first: int, most: int) -> DataFrame:
    """The ``most`` items from position ``first`` on in the order of a unique number ``key``, with ``turn`` from 0. Counts of
    ranges between approximate quantiles narrow down where the first is; only then rows are ordered, those behind it, and
    of these no more than the limit asks for."""
    low, before, size, part = None, 0, items.count(), items
    while size > RANGE_ROWS:
        cuts = sorted(set(part.approxQuantile(key, [i / 64 for i in range(1, 64)], 0.001)))
        counts = {r["_cell"]: r["count"] for r in part.groupBy(_range_of(key, cuts).alias("_cell")).count().collect()}  # 64 rows
        for cell in sorted(counts):
            if before + counts[cell] > first:
                break
            before += counts[cell]
        if counts[cell] == size:
            break  # one range holds all: no number lies between its bounds
        low = cuts[cell - 1] if cell else low
        size, part = counts[cell], part.where(_range_of(key, cuts) == cell)
    rest = items.where(F.col(key) > low) if low is not None else items
    skip = first - before
    taken = rest.orderBy(key).limit(skip + most)
    place = F.row_number().over(Window.orderBy(key)) - 1  # over what the limit left
    return taken.withColumn("turn", (place - skip).cast("long")).where(F.col("turn") >= 0)


def round_robin(items: DataFrame, key: str, most: int, cursor: int) -> tuple[DataFrame, int]:
    """(``most`` items from position ``cursor`` on, around the end, with ``turn`` from 0; the
    next cursor). 0 takes none."""
    n = items.count()
    if not n or most <= 0:
        return items.withColumn("turn", F.lit(0).cast("long")).limit(0), cursor
    start, most = cursor % n, min(most, n)
    ahead = min(most, n - start)
    batch = from_position(items, key, start, ahead)
    if most > ahead:
        batch = batch.union(from_position(items, key, 0, most - ahead).withColumn("turn", F.col("turn") + ahead))
    return batch, (cursor + most) % n


def priority_round_robin(items: DataFrame, key: str, first: Column, most: int, cursors: tuple[int, int]) -> DataFrame:
    """Turns of the items that come first, then of the others in the room that is left."""
    urgent, other = items.where(first), items.where(~F.coalesce(first, F.lit(False)))
    n = min(most, urgent.count())
    a, _ = round_robin(urgent, key, n, cursors[0])
    b, _ = round_robin(other, key, most - n, cursors[1])
    return a.union(b.withColumn("turn", F.col("turn") + n))


def stalest(items: DataFrame, seen: str, tie: str, most: int) -> DataFrame:
    """Never seen first, then the longest unseen."""
    return items.orderBy(F.asc_nulls_first(seen), F.asc(tie)).limit(most)


def status_rollup(queue: DataFrame, state: str, attempted: Column, waiting: Column) -> DataFrame:
    return queue.groupBy(state).agg(F.count("*").alias("n"), F.count_if(attempted).alias("n_attempted"), F.count_if(waiting).alias("n_waiting"))


def merge_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the highest rank, whether any is primary, the first known size, and a sticky
    published state. ``candidates`` has rank, is_primary, width, height, status, seen_at."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen_at")))
    sticky = F.when(F.bool_or(F.col("status") == "published"), F.lit("published")).otherwise(F.max_by("status", "seen_at"))
    return candidates.groupBy(*keys).agg(F.max("rank").alias("rank"), F.bool_or("is_primary").alias("is_primary"), first("width").alias("width"), first("height").alias("height"), sticky.alias("status"))


def apply_preload(queue: DataFrame, products: DataFrame, stage: DataFrame, batch: str, requested_by: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, products, stage) after a batch of codes asks for products. ``stage`` has batch_name, ean, requested_priority,
    source, queued_at; ``products`` product_id, ean, cover_url, needs_refresh, status, priority; ``queue`` product_id, ean,
    source, priority, requested_by, state, available_at, request_count. A product that several codes or rows ask for
    counts once, with its highest priority (ties: the smallest code). A job in process stays so; a product with a
    cover that needs no refresh keeps its status."""
    asked = stage.where(F.col("batch_name") == batch).select(gtin14(F.col("ean")).alias("_g"), F.col("ean").alias("_ean"), "requested_priority", F.col("source").alias("_source"))
    hits = products.select("product_id", gtin14(F.col("ean")).alias("_g")).join(asked, "_g").drop("_g")
    matched = first_by(hits, ["product_id"], [F.desc_nulls_last("requested_priority"), F.asc("_ean"), F.asc("_source")]).withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    busy = F.coalesce(F.col("state") == "processing", F.lit(False))
    queued = queue.join(matched, "product_id", "full").select(
        "product_id", F.when(hit, F.col("_ean")).otherwise(F.col("ean")).alias("ean"), F.when(hit, F.col("_source")).otherwise(F.col("source")).alias("source"),
        F.greatest("priority", "requested_priority").alias("priority"), F.when(hit, F.lit(requested_by)).otherwise(F.col("requested_by")).alias("requested_by"),
        F.when(hit & ~busy, F.lit("pending")).otherwise(F.col("state")).alias("state"), F.when(hit & ~busy, as_of).otherwise(F.col("available_at")).alias("available_at"),
        (F.coalesce("request_count", F.lit(0)) + F.when(hit, 1).otherwise(0)).alias("request_count"),
    )
    refresh = F.coalesce("needs_refresh", F.lit(False))
    due = hit & (F.col("cover_url").isNull() | refresh | F.coalesce(F.col("status").isin("missing", "queued", "failed", "review"), F.lit(False)))
    shown = F.col("cover_url").isNotNull() & ~refresh
    updated = products.join(matched.select("product_id", "requested_priority", "_hit"), "product_id", "left").select(
        *(c for c in products.columns if c not in ("status", "priority")), F.when(due & ~shown, F.lit("queued")).otherwise(F.col("status")).alias("status"),
        F.when(due, F.greatest(F.coalesce("priority", F.lit(0)), "requested_priority")).otherwise(F.col("priority")).alias("priority"),
    )
    done = F.coalesce("queued_at", F.when(F.col("batch_name") == batch, as_of))
    return queued, updated, stage.withColumn("queued_at", done)


def first_success(candidates: DataFrame, job: str, rank: str, tie: str, works: Column) -> DataFrame:
    """Per job, what trying its candidates from the highest rank on (ties: the smallest ``tie``; a null rank last) comes to: the first that
    works, how many failed before it, and published or retry_later. Aggregates alone: no job's candidates are put in order."""
    place = F.struct((-F.coalesce(rank, F.lit(-(2**31) + 1))).alias("r"), F.col(tie).alias("t"))
    ok = F.coalesce(works, F.lit(False))
    best = candidates.groupBy(job).agg(F.min(F.when(ok, place)).alias("_best"))
    tried = candidates.select(job, place.alias("_place")).join(best, job).groupBy(job).agg(
        F.any_value("_best")["t"].alias("chosen"), F.count_if(F.col("_best").isNull() | (F.col("_place") < F.col("_best"))).alias("n_failed")
    )
    return tried.withColumn("status", F.when(F.col("chosen").isNull(), F.lit("retry_later")).otherwise(F.lit("published")))


def failed_review(products: DataFrame, queue: DataFrame, key: str, status: str, columns: list[str]) -> DataFrame:
    """The products that failed or wait for review, with what the queue says of them (null where it has no row)."""
    waiting = products.where(F.col(status).isin("failed", "review"))
    return waiting.join(queue.select(key, *(F.col(c).alias(f"queue_{c}") for c in columns)), key, "left")
