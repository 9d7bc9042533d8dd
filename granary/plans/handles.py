"""Queries run by name in the background, with state, timings and results.

A result is a table in the warehouse, whatever its size; it is read by pages, and goes with
close(). A monitor may write a line of JSON to a file from time to time while a query runs.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: States of a query.
PLANNED, RUNNING, FINISHED, CANCELED, FAILED = "PLANNED", "RUNNING", "FINISHED", "CANCELED", "FAILED"
#: Rows of a page.
PAGE = 1000


def plan_tree(df: DataFrame) -> dict:
    """The physical plan of df as name, text and children of each node."""

    def node(plan) -> dict:
        children = plan.children()
        below = [node(children.apply(i)) for i in range(children.size())]
        if plan.nodeName() == "AdaptiveSparkPlan":
            below = [node(plan.executedPlan())]
        return {"name": plan.nodeName(), "text": plan.simpleString(25), "children": below}

    return node(df._jdf.queryExecution().executedPlan())


def draw(tree: dict, depth: int = 0) -> str:
    """A plan's nodes, one to a line, each as far in as it is deep."""
    return "\n".join(["  " * depth + tree["name"], *(draw(c, depth + 1) for c in tree["children"])])


class QueryHandle:
    """A query that runs in its own thread, in its own job group."""

    def __init__(self, spark: SparkSession, name: str, build):
        self.spark, self.name = spark, name
        self.id = f"{name}-{uuid.uuid4().hex[:8]}"
        self.state, self.error = PLANNED, None
        self._build, self._frame, self._names, self._types = build, None, [], None
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        self._path = f"{where}/results/{self.id}"
        self.started = self.ended = None
        self._thread = threading.Thread(target=self._run, daemon=True)

    def start(self) -> QueryHandle:
        self.state, self.started = RUNNING, time.time()
        self._thread.start()
        return self

    def _run(self) -> None:
        try:
            self.spark.sparkContext.setJobGroup(self.id, self.name, interruptOnCancel=True)
            self._frame = self._build()
            # Names may clash and types may be void, which files don't have.
            self._names = self._frame.columns
            plain = self._frame.toDF(*[f"c{i}" for i in range(len(self._names))])
            plain = plain.withColumns({c: F.col(c).cast("string") for c, kind in plain.dtypes if kind == "void"})
            placed = plain.withColumn("at", F.monotonically_increasing_id())
            self._types = placed.schema
            placed.write.parquet(self._path)
            if self.state == RUNNING:
                self.state = FINISHED
        except Exception as e:
            if self.state != CANCELED:
                self.state, self.error = FAILED, e
        finally:
            self.ended = time.time()

    def wait(self, seconds: float | None = None) -> str:
        """The state after the query has ended, or after that long."""
        self._thread.join(seconds)
        return self.state

    def cancel(self) -> None:
        if self.state in (PLANNED, RUNNING):
            self.state = CANCELED
            self.spark.sparkContext.cancelJobGroup(self.id)

    def table(self) -> DataFrame:
        """The result in its order; waits for it, and raises what the query raised."""
        self.wait()
        if self.error is not None:
            raise self.error
        if self.state != FINISHED:
            raise RuntimeError(f"the query is {self.state}")
        rows = self.spark.read.schema(self._types).parquet(self._path).orderBy("at").drop("at")
        return rows.toDF(*self._names)

    def count(self) -> int:
        """Rows of the result."""
        return self.table().count()

    def rows(self) -> Iterator[Row]:
        """All rows, of which the driver holds one partition at a time."""
        return self.table().toLocalIterator()

    def result(self, limit: int = PAGE, offset: int = 0) -> list[Row]:
        """A page of rows."""
        return self.table().offset(offset).limit(limit).collect()

    def result_json(self, limit: int = PAGE, offset: int = 0) -> str:
        return json.dumps([r.asDict(recursive=True) for r in self.result(limit, offset)], default=str)

    def close(self) -> None:
        """Delete the result."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def monitor(self, path: str, seconds: float = 0.1) -> threading.Thread:
        """Write a line of JSON to a local file (of the driver) every so often until the query has ended."""

        def watch() -> None:
            with Path(path).open("a") as out:
                while True:
                    over = self.ended is not None
                    stages = {str(k): {"done": d, "tasks": n} for k, (d, n) in self.progress().items()}
                    out.write(json.dumps({"Type": "TP", "TimeStamp": int(time.time() * 1000), "query": self.id, "state": self.state, "seconds": round(self.seconds(), 3), "stages": stages}) + "\n")
                    out.flush()
                    if over:
                        return
                    time.sleep(seconds)

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        return thread

    def seconds(self) -> float:
        """How long it has run."""
        return 0.0 if self.started is None else (self.ended or time.time()) - self.started

    def plan(self) -> str:
        """The physical plan."""
        return "" if self._frame is None else self._frame._jdf.queryExecution().executedPlan().toString()

    def plan_json(self) -> str:
        """The physical plan as JSON: name and children of each node."""
        return json.dumps({} if self._frame is None else plan_tree(self._frame))

    def progress(self) -> dict[int, tuple[int, int]]:
        """For each stage of the query that Spark still knows: tasks done, and tasks."""
        tracker, out = self.spark.sparkContext.statusTracker(), {}
        for job in tracker.getJobIdsForGroup(self.id):
            for stage in (info := tracker.getJobInfo(job)) and info.stageIds or ():
                if (s := tracker.getStageInfo(stage)) is not None:
                    out[stage] = (s.numCompletedTasks, s.numTasks)
        return out


class QueryManager:
    """Registered queries, and the handles of those started."""

    def __init__(self, spark: SparkSession, sf_dir: str, queries: dict):
        self.spark, self.sf_dir, self.queries = spark, sf_dir, queries
        self.handles: dict[str, QueryHandle] = {}

    def names(self) -> list[str]:
        return sorted(self.queries)

    def start(self, name: str) -> QueryHandle:
        if name not in self.queries:
            raise KeyError(f"the query {name} isn't registered")
        return self._begin(name, lambda: self.queries[name](self.spark, self.sf_dir))

    def start_sql(self, text: str) -> QueryHandle:
        from granary.plans.surface import run_sql

        return self._begin("sql", lambda: run_sql(self.spark, text, self.sf_dir))

    def _begin(self, name: str, build) -> QueryHandle:
        handle = QueryHandle(self.spark, name, build)
        self.handles[handle.id] = handle
        return handle.start()

    def list(self) -> list[dict]:
        return [{"id": h.id, "name": h.name, "state": h.state, "seconds": h.seconds()} for h in self.handles.values()]
