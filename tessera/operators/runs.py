"""Events of processing runs in batch: sliding limits, stale runs, the run state machine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Windows of time that one sorted part of a key's events spans.
PART_WINDOWS = 16


def sliding_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Adds ``in_window``: events of the key in the last ``seconds``, the present one included.

    An event exactly one window old has left it, so the range starts a microsecond later.  A key's events are sorted in
    parts of ``PART_WINDOWS`` windows; each part also holds a copy of the window before it, so a busy key is spread.
    """
    span = seconds * 1_000_000
    width = F.lit(PART_WINDOWS * span)
    timed = events.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_part", F.floor(F.col("_at") / width)).withColumn("_copy", F.lit(False))
    before = timed.where(F.pmod("_at", width) > width - span).withColumn("_part", F.col("_part") + 1).withColumn("_copy", F.lit(True))
    running = Window.partitionBy(key, "_part").orderBy("_at").rangeBetween(1 - span, 0)
    counted = timed.unionByName(before).withColumn("in_window", F.count("*").over(running))
    return counted.where("not _copy").drop("_at", "_part", "_copy")


def stale(runs: DataFrame, now: Column, status: str = "status", updated: str = "updated_at", minutes: int = 5) -> DataFrame:
    """Running runs without an update for longer than ``minutes`` are failed."""
    late = (F.col(status) == "running") & (F.col(updated) < now - F.expr(f"interval {minutes} minutes"))
    return runs.withColumn(status, F.when(late, "failed").otherwise(F.col(status)))


def run_states(events: DataFrame, key: str, order: list[str], kind: str, completed: Sequence[str], failed: Sequence[str]) -> DataFrame:
    """The state of each run after all its events: the last one decides; completed and failed steps are counted."""
    latest = F.max_by(kind, F.struct(*order))
    return events.groupBy(key).agg(latest.alias("last_event"), F.count("*").alias("n_events"), F.count_if(F.col(kind).isin(*completed)).alias("n_completed"), F.count_if(F.col(kind).isin(*failed)).alias("n_failed"))


#: The levels of a stage in order, and how often a failed step is tried.
LEVELS = ("deterministic", "llm_check", "llm_qa", "operator_review", "user_validation")
RETRIES = {"deterministic": 1, "llm_check": 3, "llm_qa": 3, "operator_review": 1, "user_validation": 1}


def idempotency_key(run: Column, level: Column, attempt: Column) -> Column:
    return F.concat_ws(":", run, level, attempt.cast("string"))


def run_pipeline(handlers: dict, completed: set[str] = frozenset(), retries: dict[str, int] = RETRIES) -> list[tuple[str, str, int]]:
    """Run a stage's levels in order: (level, status, attempts).

    Completed levels are reused, missing handlers skipped; a level that says it needs no next step halts the run,
    and one that fails in all its attempts fails it.  Handlers take the attempt and return whether to go on.
    """
    steps = []
    for level in LEVELS:
        if level in completed:
            steps.append((level, "reused", 0))
            continue
        if level not in handlers:
            steps.append((level, "skipped", 0))
            continue
        for attempt in range(1, retries[level] + 1):
            try:
                go_on = handlers[level](attempt)
            except Exception:  # noqa: BLE001  a handler's failure is a result here
                continue
            steps.append((level, "completed", attempt))
            break
        else:
            steps.append((level, "failed", retries[level]))
            break
        if go_on is False:
            break
    return steps


#: A level's work on runs: from their ``run`` and the attempt, whether each is ``ok`` and goes on (``go_on``).
Handler = Callable[[DataFrame, int], DataFrame]
STEP = "run string, level string, attempt int, status string, go_on boolean"


def run_levels(runs: DataFrame, handlers: dict[str, Handler], path: str, completed: DataFrame | None = None, retries: dict[str, int] = RETRIES) -> DataFrame:
    """Take all ``runs`` through the levels, one written step for each level and attempt: ``run``, ``level``, ``status``, ``attempts``.

    The rules are those of ``run_pipeline``: levels in ``completed`` (``run``, ``level``) are reused, levels without a handler
    skipped, failed attempts tried again, and a run ends where it failed or needs no next step.  A run that a
    handler gives no row for has failed.  Every step is a table below ``path`` that counts once it is whole, so a job that
    was killed goes on after its last whole step when it is started again, and no step's work is counted twice.
    """
    spark = runs.sparkSession
    alive, steps = runs.select(F.col("run").cast("string").alias("run")).distinct(), []

    def step(name: str, rows: Callable[[], DataFrame]) -> DataFrame:
        target = f"{path}/{name}"
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            rows().write.mode("overwrite").parquet(target)
        return spark.read.schema(STEP).parquet(target)

    def plain(rows: DataFrame, level: str, status: str) -> DataFrame:
        return rows.select("run", F.lit(level).alias("level"), F.lit(status).alias("status"), F.lit(0).alias("attempts"))

    for level in LEVELS:
        if completed is not None:
            known = completed.where(F.col("level") == level).select(F.col("run").cast("string").alias("run")).distinct()
            reused = alive.join(known, "run", "left_semi")
            steps.append(plain(reused, level, "reused"))
            waiting = alive.join(known, "run", "left_anti")
        else:
            reused, waiting = alive.limit(0), alive
        if level not in handlers:
            steps.append(plain(waiting, level, "skipped"))
            continue
        going = reused
        for attempt in range(1, retries[level] + 1):

            def work(waiting: DataFrame = waiting, attempt: int = attempt, level: str = level) -> DataFrame:
                done = handlers[level](waiting, attempt).select(F.col("run").cast("string").alias("run"), "ok", "go_on")
                status = F.when(F.coalesce("ok", F.lit(False)), "completed").otherwise("failed")
                return waiting.join(done, "run", "left").select("run", F.lit(level).alias("level"), F.lit(attempt).alias("attempt"), status.alias("status"), F.coalesce("go_on", F.lit(True)).alias("go_on"))

            found = step(f"{level}-{attempt}", work)
            last = attempt == retries[level]
            steps.append((found if last else found.where("status = 'completed'")).select("run", "level", "status", F.col("attempt").alias("attempts")))
            going = going.unionByName(found.where("status = 'completed' and go_on").select("run"))
            waiting = found.where("status = 'failed'").select("run")
        alive = going
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out


def backoff_seconds(attempt: int, base: float = 5.0) -> float:
    """Seconds to wait before the next attempt."""
    return base * 2 ** (attempt - 1)


def overlap_cells(drawings: DataFrame, cells: DataFrame, key: str = "table_id", share: float = 0.6) -> DataFrame:
    """Cells that a drawing covers by at least ``share`` of their area; boxes are x, y, w, h.

    An equi join on the table with interval conditions inside.
    """
    d, c = drawings.alias("d"), cells.alias("c")
    width = F.least(F.col("d.x") + F.col("d.w"), F.col("c.x") + F.col("c.w")) - F.greatest("d.x", "c.x")
    height = F.least(F.col("d.y") + F.col("d.h"), F.col("c.y") + F.col("c.h")) - F.greatest("d.y", "c.y")
    near = (F.col("d.x") < F.col("c.x") + F.col("c.w")) & (F.col("c.x") < F.col("d.x") + F.col("d.w")) & (F.col("d.y") < F.col("c.y") + F.col("c.h")) & (F.col("c.y") < F.col("d.y") + F.col("d.h"))
    area = (width * height) / (F.col("c.w") * F.col("c.h"))
    return d.join(c, (F.col(f"d.{key}") == F.col(f"c.{key}")) & near & (area >= share)).select(F.col(f"d.{key}").alias(key), "d.drawing_id", "c.cell_id", F.round(area, 6).alias("share"))
