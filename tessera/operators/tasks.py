"""Batch semantics of the task log: listing, claiming, leases, state, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators._kept import kept


def page(tasks: DataFrame, number: int, size: int, *filters: Column) -> DataFrame:
    """One page of the tasks that pass the filters, newest first, ties by id."""
    for f in filters:
        tasks = tasks.where(f)
    return tasks.orderBy(F.desc("created_at"), "id").offset((number - 1) * size).limit(size)


def claim_next(tasks: DataFrame, worker: str, now: Column, per: list[str] | None = None) -> DataFrame:
    """The oldest pending task with attempts left (of each group ``per``), as it is once claimed."""
    free = tasks.where((F.col("status") == "PENDING") & (F.col("attempt_count") < F.col("max_attempts")))
    if per:
        first = free.groupBy(*per).agg(F.min(F.struct("created_at", "id")).alias("_m")).select(F.col("_m.id").alias("id"))
        chosen = free.join(first, "id", "left_semi")
    else:
        chosen = free.orderBy("created_at", "id").limit(1)
    return chosen.withColumns({"status": F.lit("RUNNING"), "attempt_count": F.col("attempt_count") + 1, "worker_id": F.lit(worker), "heartbeat_at": now})


def update(tasks: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """tasks with the changes of those that their worker still owns and runs. changes: id, worker_id and the columns."""
    c = changes.select("id", F.col("worker_id").alias("_w"), *[F.col(x).alias(f"_{x}") for x in columns])
    joined = tasks.join(c, "id", "left")
    own = (F.col("_w") == F.col("worker_id")) & (F.col("status") == "RUNNING")
    return joined.withColumns({x: F.when(own, F.col(f"_{x}")).otherwise(F.col(x)) for x in columns}).select(*tasks.columns)


def recover_stale(tasks: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Running tasks whose heartbeat is older than ``seconds``: PENDING again, or FAILED with WORKER_LOST if no attempt is left."""
    stale = tasks.where((F.col("status") == "RUNNING") & (F.col("heartbeat_at") < now - F.expr(f"make_dt_interval(0, 0, 0, {seconds})")))
    again = F.col("attempt_count") < F.col("max_attempts")
    return stale.withColumns({"status": F.when(again, "PENDING").otherwise("FAILED"), "error": F.when(~again, "WORKER_LOST"), "worker_id": F.lit(None).cast("string")})


def current_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key in an append-only event log."""
    last = F.struct(*order)
    return events.groupBy(key).agg(F.max_by(state, last).alias(state), F.max(order[0]).alias(order[0]), F.count(F.lit(1)).alias("events"))


def retry(tasks: DataFrame, new_id: Column, now: Column) -> DataFrame:
    """Copies of the failed tasks, pending and with their source."""
    return tasks.where("status = 'FAILED'").withColumns({"source_task_id": F.col("id"), "id": new_id, "status": F.lit("PENDING"), "attempt_count": F.lit(0), "created_at": now})


def lineage(tasks: DataFrame) -> DataFrame:
    """(id, root, steps): the first task of each chain of retries; links are followed in doubling steps until none goes on. A chain that closes a ring has no root (null)."""
    at = kept(tasks.select("id", F.col("source_task_id").alias("up"), F.when(F.col("source_task_id").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    open_, longest = at.where("up is not null").count(), 1
    while open_ and longest <= 2 * open_:
        on = at.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"))
        new = kept(at.join(on, "up", "left").select("id", F.coalesce("far", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        at, longest = new.select("id", "up", "steps"), 2 * longest
        if not moved:
            return at.select("id", F.coalesce("up", "id").alias("root"), "steps")
    # still moving after more steps than there are links: what is left are rings
    ring = at.select(F.col("id").alias("up"), F.col("up").isNotNull().alias("goes_on"))
    ended = at.join(ring, "up", "left").withColumn("ring", F.coalesce("goes_on", F.lit(False)))
    return ended.select("id", F.when(~F.col("ring"), F.coalesce("up", "id")).alias("root"), F.when(~F.col("ring"), F.col("steps")).alias("steps"))


def regenerable(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Succeeded draft reviews with exactly three hashed files in role order and no regeneration yet."""
    right = files.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "role", "sha256"))).alias("f"))
    roles = F.transform("f", lambda x: x["role"])
    ok = right.where((F.size("f") == 3) & (roles == F.array(F.lit("TARGET"), F.lit("TEMPLATE"), F.lit("REFERENCE"))) & ~F.exists("f", lambda x: x["sha256"].isNull())).select(F.col("task_id").alias("id"))
    child = tasks.where("task_type = 'REPORT_REGENERATION'").select(F.col("source_task_id").alias("id"))
    return tasks.where("task_type = 'DRAFT_REVIEW' and status = 'SUCCEEDED'").join(ok, "id", "left_semi").join(child, "id", "left_anti")


def _longest_start(refs: DataFrame, files: DataFrame, file: str) -> DataFrame:
    """(ref, file): the longest file id that each reference begins with; joined on the references' beginnings, of the lengths that ids have."""
    lengths = files.select(F.length(file).alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("_n"))  # one row of lengths
    starts = refs.select("ref").distinct().join(F.broadcast(lengths)).select("ref", F.explode("_n").alias("n")).where(F.length("ref") >= F.col("n")).withColumn(file, F.expr("substring(ref, 1, n)"))
    return starts.join(files.select(file).distinct(), file).groupBy("ref").agg(F.max_by(file, F.length(file)).alias(file))


def remap_references(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """refs (ref) with new_ref: the longest old file id that the reference begins with replaced by its new one. mapping: (old, new)."""
    best = _longest_start(refs, mapping, "old").join(mapping.dropDuplicates(["old"]), "old")
    return refs.select("ref").distinct().join(best, "ref", "left").select("ref", F.when(F.col("old").isNull(), F.col("ref")).otherwise(F.concat("new", F.expr("substring(ref, length(old) + 1)"))).alias("new_ref"))


def expired(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Uploads older than the retention."""
    return files.where(F.col("created_at") < now - F.expr(f"make_dt_interval({days})"))


def backfill_counts(tasks: DataFrame) -> DataFrame:
    """Old grades to new counts: risks are high and medium, reviews low and info."""
    return tasks.withColumns({"risk_count": F.coalesce("high", F.lit(0)) + F.coalesce("medium", F.lit(0)), "review_count": F.coalesce("low", F.lit(0)) + F.coalesce("info", F.lit(0))})


def renumbered(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """rows with batch: consecutive groups of ``size`` within the keys."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def remap_problems(refs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """References (ref) of a remapped result that are still old, or name no new file, with the problem. old, new: (file)."""
    begins = lambda files, flag: _longest_start(refs, files, "file").select("ref", F.lit(True).alias(flag))
    marked = refs.select("ref").distinct().join(begins(old, "is_old"), "ref", "left").join(begins(new, "is_new"), "ref", "left")
    problem = F.when(F.col("is_old") & F.col("is_new").isNull(), "OLD").when(F.col("is_new").isNull(), "UNKNOWN")
    return marked.withColumn("problem", problem).where("problem is not null").select("ref", "problem")


def count(tasks: DataFrame, *filters: Column) -> DataFrame:
    """How many tasks pass the filters, for the page's total."""
    for f in filters:
        tasks = tasks.where(f)
    return tasks.agg(F.count(F.lit(1)).alias("total"))


def create(requests: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The rows that new tasks add: tasks, task_files and task_events.

    requests: (id, task_type, reference, files array<struct<role, url, sha256>>, source_task_id).
    """
    new = requests.select("id", "task_type", "reference", "source_task_id", F.lit("PENDING").alias("status"), F.lit(0).alias("attempt_count"), now.alias("created_at"))
    files = requests.select(F.col("id").alias("task_id"), F.posexplode("files").alias("ordinal", "f")).select("task_id", "ordinal", "f.*")
    events = requests.select(F.col("id").alias("task_id"), F.lit(None).cast("string").alias("from_status"), F.lit("PENDING").alias("to_status"), now.alias("at"))
    return {"tasks": new, "task_files": files, "task_events": events}


def _own(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """The results (id, worker_id, ...) of tasks that their worker still runs."""
    held = tasks.where("status = 'RUNNING'").select("id", F.col("worker_id").alias("_w"))
    return results.join(held, "id").where(F.col("_w") == F.col("worker_id")).drop("_w")


def complete(tasks: DataFrame, files: DataFrame, results: DataFrame, metadata: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables after results (id, worker_id, result) are in: tasks and task_files as they are then, rows for task_results and task_events.

    Results of tasks that another worker took over change nothing. metadata: (task_id, ordinal, pages) of parsed files.
    """
    mine = _own(tasks, results)
    done = mine.select("id", F.lit(True).alias("_done"))
    ended = {"status": F.when(F.col("_done"), "SUCCEEDED").otherwise(F.col("status")), "completed_at": F.when(F.col("_done"), now).otherwise(F.col("completed_at"))}
    after = tasks.join(done, "id", "left").withColumns(ended).select(*tasks.columns)
    own_files = metadata.join(mine.select(F.col("id").alias("task_id")), "task_id", "left_semi").select("task_id", "ordinal", F.col("pages").alias("_p"))
    files = files.join(own_files, ["task_id", "ordinal"], "left").withColumn("pages", F.coalesce("_p", "pages")).select(*files.columns)
    events = mine.select(F.col("id").alias("task_id"), F.lit("RUNNING").alias("from_status"), F.lit("SUCCEEDED").alias("to_status"), now.alias("at"))
    return {"tasks": after, "task_files": files, "task_results": mine.select(F.col("id").alias("task_id"), "result"), "task_events": events}


def fail(tasks: DataFrame, failures: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The same for failures (id, worker_id, code, message)."""
    mine = _own(tasks, failures).select("id", F.col("code").alias("_code"), "message")
    after = tasks.join(mine, "id", "left").withColumns({"status": F.when(F.col("_code").isNotNull(), "FAILED").otherwise(F.col("status")), "error": F.coalesce("_code", "error"), "completed_at": F.when(F.col("_code").isNotNull(), now).otherwise(F.col("completed_at"))})
    events = mine.select(F.col("id").alias("task_id"), F.lit("RUNNING").alias("from_status"), F.lit("FAILED").alias("to_status"), now.alias("at"), "message")
    return {"tasks": after.select(*tasks.columns), "task_events": events}
