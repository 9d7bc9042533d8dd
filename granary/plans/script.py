"""A small script language to run and tune queries.

    BEGIN;
    START_QUERY q1_pricing_summary;
    WAIT_QUERY 1000;
    ADD_CONCURRENCY 2;
    PREDICT_TIME 2;
    END;

Statements end with a semicolon. What a running stage can't be given in Spark holds
for the queries that start next: ADD_CONCURRENCY multiplies the shuffle partitions,
ADD_PARALLELISM QUERY,n adds n and ADD_PARALLELISM_TO_INIT QUERY,n sets them to
n more than when the script began; with STAGE,s,n the stages of a query have them in common.
LISTEN BUILD,STAGE,s waits until stage s, by the order in which stages came, is done.
R_CONFIG SET_TABLE_SCAN_SIZE,table,bytes holds for one table, R_CONFIG name,value for the session.
"""

from __future__ import annotations

import time

from granary.plans import tuning
from granary.plans.handles import QueryManager
from granary.sources import catalog

#: Instructions, and how many arguments each takes (None: the rest of the line).
INSTRUCTIONS = {
    "START_QUERY": (1,), "START_AND_COLLECT": (1,), "WAIT_QUERY": (1,), "ADD_CONCURRENCY": (1,), "ADD_PARALLELISM": (2, 3), "ADD_PARALLELISM_TO_INIT": (2, 3),
    "R_CONFIG": (2, 3), "LISTEN": (3,), "ECHO": None, "PREDICT_TIME": (1, 2), "START_AUTO_TUNE": (1,), "CANCEL_QUERY": (0,),
}


class ScriptError(ValueError):
    """A script that can't be run."""


def parse(text: str) -> list[tuple[str, list[str]]]:
    """Instructions and their arguments; ScriptError says what is wrong."""
    parts = [x.strip() for x in text.split(";")]
    if parts[-1]:
        raise ScriptError("the last statement doesn't end with a semicolon")
    parts = [x for x in parts if x]
    if len(parts) < 2 or parts[0] != "BEGIN" or parts[-1] != "END":
        raise ScriptError("a script begins with BEGIN; and ends with END;")
    out = []
    for x in parts[1:-1]:
        name, _, rest = x.partition(" ")
        if name not in INSTRUCTIONS:
            raise ScriptError(f"the instruction {name} isn't known")
        count = INSTRUCTIONS[name]
        arguments = [rest] if count is None else [a.strip() for a in rest.split(",") if a.strip()]
        if count is not None and len(arguments) not in count:
            raise ScriptError(f"{name} takes {' or '.join(map(str, count))} arguments")
        if name.startswith("ADD_PARALLELISM") and not (arguments[0] == ("QUERY" if len(arguments) == 2 else "STAGE") and all(a.isdigit() and int(a) > 0 for a in arguments[1:])):
            raise ScriptError(f"{name} takes QUERY,n or STAGE,s,n")
        if name == "LISTEN" and not (arguments[:2] == ["BUILD", "STAGE"] and arguments[2].isdigit()):
            raise ScriptError("LISTEN takes BUILD,STAGE,s")
        if name == "R_CONFIG" and len(arguments) == 3 and not (arguments[0] == "SET_TABLE_SCAN_SIZE" and arguments[2].isdigit() and int(arguments[2]) > 0):
            raise ScriptError("R_CONFIG takes SET_TABLE_SCAN_SIZE,table,bytes or name,value")
        out.append((name, arguments))
    return out


class Runner:
    """Runs scripts over a query manager; `log` has a line for what each instruction told."""

    def __init__(self, manager: QueryManager):
        self.manager, self.log = manager, []
        self.last = None
        self.initial = self._partitions()

    def run(self, text: str) -> list[str]:
        for name, arguments in parse(text):
            getattr(self, f"_{name.lower()}")(*arguments)
        return self.log

    def _partitions(self) -> int:
        return int(self.manager.spark.conf.get("spark.sql.shuffle.partitions"))

    def _set_partitions(self, n: int) -> None:
        tuning.configure(self.manager.spark, stage_concurrency=n)
        self.log.append(f"shuffle partitions: {n}")

    def _add_parallelism(self, kind: str, *numbers: str) -> None:
        self._set_partitions(self._partitions() + int(numbers[-1]))

    def _add_parallelism_to_init(self, kind: str, *numbers: str) -> None:
        self._set_partitions(self.initial + int(numbers[-1]))

    def _listen(self, build: str, stage: str, number: str) -> None:
        query = self._current()
        while query.ended is None:
            stages = sorted(query.progress().items())
            if len(stages) > int(number) and stages[int(number)][1][0] == stages[int(number)][1][1]:
                break
            time.sleep(0.05)
        self.log.append(f"{query.name}: stage {number} is done")

    def _current(self):
        if self.last is None:
            raise ScriptError("no query has been started")
        return self.last

    def _start_query(self, name: str) -> None:
        self.last = self.manager.start(name)
        self.log.append(f"started {name}")

    def _start_and_collect(self, name: str) -> None:
        self._start_query(name)
        self.log.append(f"{name}: {self.last.count()} rows")

    def _wait_query(self, milliseconds: str) -> None:
        if self.last is None:
            time.sleep(int(milliseconds) / 1000)
        else:
            self.log.append(f"{self.last.name}: {self.last.wait(int(milliseconds) / 1000)}")

    def _cancel_query(self) -> None:
        self._current().cancel()
        self.log.append(f"{self.last.name}: {self.last.state}")

    def _add_concurrency(self, factor: str) -> None:
        self._set_partitions(max(1, int(self._partitions() * float(factor))))

    def _r_config(self, name: str, *values: str) -> None:
        if len(values) == 2:
            catalog.set_scan_size(values[0], int(values[1]))
        else:
            tuning.configure(self.manager.spark, **{name: values[0]})
        self.log.append(f"{name} = {', '.join(values)}")

    def _echo(self, text: str) -> None:
        self.log.append(text)

    def _figures(self, stage: int | None = None) -> tuning.StageFigures:
        """Tasks stand for rows: those left, and those done a second, of the query or of one stage by its order."""
        query = self._current()
        progress = [x for k, (_, x) in enumerate(sorted(query.progress().items())) if stage in (None, k)]
        done, tasks = sum(x[0] for x in progress), sum(x[1] for x in progress)
        return tuning.StageFigures(tasks - done, done / max(query.seconds(), 1e-3))

    def _predict_time(self, *arguments: str) -> None:
        """A factor, or a stage and a factor."""
        figures = self._figures(int(arguments[0]) if len(arguments) == 2 else None)
        self.log.append(f"predicted seconds: {tuning.predict_seconds(figures, float(arguments[-1])):.3f}")

    def _start_auto_tune(self, seconds: str) -> None:
        n = tuning.choose_parallelism(self._figures(), float(seconds))
        self._add_concurrency(str(n))
