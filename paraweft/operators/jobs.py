"""Tasks as rows: state, progress and estimates; and a runner whose tasks Spark schedules."""

from __future__ import annotations

import inspect
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paraweft.config import EngineConfig
from paraweft.operators import markdown

STATES = ("pending", "processing", "completed", "failed", "cancelled")


def message(status: Column, progress: Column) -> Column:
    """What a task says of itself."""
    working = F.when(progress < 20, "reading").when(progress < 40, "parsing").when(progress < 80, "segmenting").otherwise("assembling")
    return F.when(status == "processing", working).otherwise(status)


def with_estimates(tasks: DataFrame, now: Column) -> DataFrame:
    """Adds ``message``, ``elapsed`` and ``remaining`` seconds to rows of (task_id, status, progress, started, ended), times in seconds."""
    elapsed = F.coalesce(F.col("ended"), now) - F.col("started")
    left = F.when((F.col("status") == "processing") & (F.col("progress") > 0), elapsed / (F.col("progress") / 100) - elapsed)
    return tasks.withColumns({"message": message(F.col("status"), F.col("progress")), "elapsed": F.round(elapsed, 3), "remaining": F.round(left, 3)})


def expired(tasks: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Finished tasks that ended so long ago."""
    return tasks.where(F.col("status").isin("completed", "failed", "cancelled") & (F.coalesce("ended", "started") < now - hours * 3600))


class Tasks:
    """Jobs of this driver, each in a job group of its own, so that a running one can be cancelled."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self._lock = spark, {}, threading.Lock()

    def submit(self, work: Callable[..., object]) -> str:
        """Run ``work`` in a thread; if it takes an argument, it gets a function that reports its percentage."""
        task = "task_" + uuid.uuid4().hex[:8]
        self.rows[task] = {"task_id": task, "status": "pending", "progress": 0, "started": time.time(), "ended": None, "result": None, "error": None}

        def run() -> None:
            row = self.rows[task]
            with self._lock:
                if row["status"] != "pending":
                    return
                row.update(status="processing", progress=10)
            self.spark.sparkContext.setJobGroup(task, task, interruptOnCancel=True)
            try:
                takes = len(inspect.signature(work).parameters) > 0
                result = work(lambda percent: self._progress(row, percent)) if takes else work()
                row.update(result=result, status="completed", progress=100)
            except Exception as e:  # noqa: BLE001  kept for who asks
                row.update(status="cancelled" if row["status"] == "cancelled" else "failed", error=str(e))
            row["ended"] = time.time()

        self.rows[task]["thread"] = threading.Thread(target=run, daemon=True)
        self.rows[task]["thread"].start()
        return task

    @staticmethod
    def _progress(row: dict, percent: float) -> None:
        """Steps of 5 percent or more; a cancelled task learns here that it is."""
        if row["status"] == "cancelled":
            raise RuntimeError("cancelled")
        if percent - row["progress"] >= 5:
            row["progress"] = min(int(percent), 100)

    def estimates(self) -> DataFrame:
        """All tasks with what they say of themselves, how long they took and how long they may still take."""
        return with_estimates(self.table(), F.lit(time.time()))

    def status(self, task: str) -> dict | None:
        row = self.rows.get(task)
        return None if row is None else {k: v for k, v in row.items() if k not in ("thread", "result")}

    def result(self, task: str, timeout: float | None = None):
        row = self.rows[task]
        row["thread"].join(timeout)
        return row["result"] if row["status"] == "completed" else None

    def cancel(self, task: str) -> bool:
        row = self.rows.get(task)
        if row is None or row["status"] not in ("pending", "processing"):
            return False
        row["status"] = "cancelled"
        self.spark.sparkContext.cancelJobGroup(task)
        return True

    def cleanup(self, hours: float = 24) -> int:
        old = [k for k, r in self.rows.items() if r["ended"] and r["ended"] < time.time() - hours * 3600]
        for k in old:
            del self.rows[k]
        return len(old)

    def table(self) -> DataFrame:
        rows = [(r["task_id"], r["status"], r["progress"], r["started"], r["ended"]) for r in self.rows.values()]
        return self.spark.createDataFrame(rows, "task_id string, status string, progress int, started double, ended double")


def markdown_job(tasks: Tasks, docs: DataFrame, config: EngineConfig, path: str, id_col: str = "doc_id", text_col: str = "markdown") -> str:
    """Process Markdown documents as a task: each step is written below ``path`` and reported; the result is the last table. Returns the task's name."""

    def work(report: Callable[[float], None]) -> DataFrame:
        def step(name: str, percent: int, rows: DataFrame) -> DataFrame:
            schema = rows.schema
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            report(percent)
            return tasks.spark.read.schema(schema).parquet(f"{path}/{name}")

        return markdown.process(docs, config, None, id_col, text_col, step)

    return tasks.submit(work)


def health(spark: SparkSession, tasks: Tasks | None = None) -> dict[str, object]:
    """Whether the session answers, its version and cores, and how many tasks are in each state."""
    began = time.time()
    alive = spark.range(1).count() == 1
    counts = {s: sum(r["status"] == s for r in tasks.rows.values()) for s in STATES} if tasks else {}
    return {"status": "healthy" if alive else "unhealthy", "spark": spark.version, "cores": spark.sparkContext.defaultParallelism, "seconds": round(time.time() - began, 3), "tasks": counts}
