"""Predicting stage times and choosing parallelism from observed figures.

Spark can't change the parallelism of a running stage; what is chosen here
applies to the next run (adaptive execution re-plans between stages on its
own). The functions are plain arithmetic on observed figures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

#: The largest degree of parallelism that is tried, and the one taken if none is fast enough.
MOST, FALLBACK = 10, 8


@dataclass(frozen=True)
class StageFigures:
    """What was observed of a stage. Shares are of what one machine has, from 0 to 1."""

    remaining_rows: float
    rows_per_second: float
    build_seconds: float = 0.0
    cpu_share: float = 0.0
    send_share: float = 0.0
    receive_share: float = 0.0


def remaining_seconds(f: StageFigures) -> float:
    """Rows left by the rate at which they go; endless if none do."""
    if f.remaining_rows <= 0:
        return 0.0
    return f.remaining_rows / f.rows_per_second if f.rows_per_second > 0 else float("inf")


def headroom(share: float) -> float:
    """How many times more of a resource could be used."""
    return float("inf") if share <= 0 else max(1.0, 1.0 / share)


def predict_seconds(f: StageFigures, factor: float) -> float:
    """Time that a stage still takes if its parallelism grows by a factor.

    The part after the hash table is built shrinks by the factor, but no more than
    CPU and network have room for; the build itself is done anew.
    """
    if factor < 1:
        raise ValueError("the factor is at least 1")
    left = max(0.0, remaining_seconds(f) - f.build_seconds)
    gain = min(factor, headroom(f.cpu_share), headroom(f.send_share), headroom(f.receive_share))
    return left / gain + f.build_seconds


def bottleneck(f: StageFigures, full: float = 0.9) -> str:
    """cpu, send, receive, or none."""
    share, name = max((f.cpu_share, "cpu"), (f.send_share, "send"), (f.receive_share, "receive"))
    return name if share >= full else "none"


def bottlenecks(stages: dict[str, StageFigures]) -> dict[str, str]:
    return {k: b for k, f in stages.items() if (b := bottleneck(f)) != "none"}


def worth_rebuilding(f: StageFigures) -> bool:
    """Whether a change of parallelism pays: not if building takes longer than what is left."""
    return f.build_seconds < remaining_seconds(f)


def choose_parallelism(f: StageFigures, seconds: float) -> int:
    """The least degree that is predicted to end in time; the fallback if there is none."""
    for n in range(1, MOST + 1):
        if predict_seconds(f, n) <= seconds:
            return n
    return FALLBACK


def choose_partitions(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Shuffle partitions: of the target size, a whole number of waves over the cores."""
    wanted = max(1, -(-input_bytes // target_bytes))
    return -(-wanted // cores) * cores


#: Execution settings, and the Spark settings that they stand for.
SETTINGS = {
    "table_scan_size": "spark.sql.files.maxPartitionBytes",
    "tableScanBatchSize": "spark.sql.parquet.columnarReaderBatchSize",
    "stage_concurrency": "spark.sql.shuffle.partitions",
    "initial_intra_stage_concurrency": "spark.sql.shuffle.partitions",
    "initial_hash_partition_concurrency": "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
    "partition_size": "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "broadcast_size": "spark.sql.autoBroadcastJoinThreshold",
}
#: Settings that Spark's own scheduling makes void: they are accepted and change nothing.
WITHOUT_EFFECT = (
    "initial_intra_task_concurrency", "initial_task_group_concurrency", "intra_task_hash_build_concurrency", "initial_shuffle_executor_nums",
    "TEST_system_add_intra_stage_concurrency", "TEST_system_add_intra_task_concurrency", "TEST_system_add_task_group_concurrency",
    "task_group_close_mode", "lazy_task_group_close_mode", "doNotUseStorageNode", "intial_plan_used_nodes",
)


def configure(spark: SparkSession, **settings) -> dict[str, str | None]:
    """Set settings for the queries that follow; gives their values before."""
    before = {}
    for name, value in settings.items():
        if name in WITHOUT_EFFECT:
            continue
        if name == "log_level":
            spark.sparkContext.setLogLevel(str(value).upper())
            continue
        if name not in SETTINGS:
            raise KeyError(f"the setting {name} isn't known")
        before[name] = spark.conf.get(SETTINGS[name], None)
        spark.conf.set(SETTINGS[name], str(value))
    return before


@dataclass
class TunerPlan:
    """Seconds that each named query may take; queries that aren't named aren't tuned."""

    seconds: dict[str, float]


class TunerManager:
    """Watches started queries and chooses the parallelism of the next run of each.

    A stage that runs keeps its tasks; what is learnt of it between polls
    sets spark.sql.shuffle.partitions before the query is started again.
    """

    def __init__(self, manager, plan: TunerPlan, poll_seconds: float = 0.2):
        self.manager, self.plan, self.poll_seconds = manager, plan, poll_seconds
        self.chosen: dict[str, int] = {}
        self.log: list[dict] = []

    def run(self, name: str):
        """Start a query with what was chosen for it, watch it until it ends, and choose for the next time. Gives its handle."""
        if name in self.chosen:
            configure(self.manager.spark, stage_concurrency=self.chosen[name])
        handle = self.manager.start(name)
        while handle.wait(self.poll_seconds) in ("PLANNED", "RUNNING"):
            self._watch(name, handle)
        if name in self.plan.seconds:
            now = int(self.manager.spark.conf.get("spark.sql.shuffle.partitions"))
            if handle.seconds() > self.plan.seconds[name]:
                # All work stands as rows left: the degree that would have ended in time.
                factor = choose_parallelism(StageFigures(handle.seconds(), 1.0), self.plan.seconds[name])
                self.chosen[name] = now * factor
            else:
                self.chosen.setdefault(name, now)
            self.log.append({"query": name, "seconds": handle.seconds(), "target": self.plan.seconds[name], "next_partitions": self.chosen[name]})
        return handle

    def _watch(self, name: str, handle) -> None:
        stages = {k: x for k, x in handle.progress().items() if x[0] < x[1]}
        for stage, (done, tasks) in stages.items():
            figures = StageFigures(tasks - done, done / max(handle.seconds(), 1e-3))
            self.log.append({"query": name, "stage": stage, "remaining_seconds": remaining_seconds(figures)})
