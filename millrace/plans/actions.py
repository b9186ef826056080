"""User actions, jobs and their order."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Context:
    """What an action sees of its job: the properties, and objects by key. put() is for the action's own partition;
    gather() returns what all partitions have put."""

    def __init__(self, properties: dict[str, str] | None = None, objects: dict | None = None):
        self.properties, self.objects, self.own = dict(properties or {}), objects or {}, {}

    def get(self, key, default=None):
        return self.own.get(key, self.objects.get(key, default))

    def put(self, key, value) -> None:
        self.own[key] = value


class Action:
    """One instance per partition: start once, process each row (0 to n rows out), stop may still give rows.
    parameters: name to (type, default, required). context: the job's properties and shared objects."""

    parameters: dict[str, tuple[type, object, bool]] = {}
    schema: str = ""
    context: Context = Context()

    def __init__(self, **values):
        if unknown := set(values) - set(self.parameters):
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        for name, (kind, default, required) in self.parameters.items():
            value = values.get(name, default)
            if value is None and required:
                raise ValueError(f"parameter {name} is required")
            if value is not None and not isinstance(value, kind):
                raise ValueError(f"parameter {name} is of type {kind.__name__}")
            setattr(self, name, value)

    def start(self) -> None:
        pass

    def process(self, row: tuple) -> Iterator[tuple]:
        yield row

    def stop(self) -> Iterator[tuple]:
        yield from ()


def _contexts(df: DataFrame, job: Job | None) -> Callable[[], Context]:
    """Makes each partition's context. The job's shared objects, as they are now, travel as one broadcast: they are
    the program's own few, not data."""
    if job is None:
        return Context
    sent, properties = df.sparkSession.sparkContext.broadcast(dict(job.shared)), dict(job.properties)
    return lambda: Context(properties, sent.value)


def apply(df: DataFrame, make: Callable[[], Action], schema: str | None = None, job: Job | None = None) -> DataFrame:
    """Runs an action over rows, batch by batch. With a job the action's context has its properties and objects."""
    from pyspark.sql.types import StructType

    schema = schema or make().schema or df.schema
    if not isinstance(schema, StructType):
        schema = df.sparkSession.createDataFrame([], schema).schema
    context = _contexts(df, job)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, action = to_arrow_schema(schema), make()
        action.context = context()
        out = lambda rows: pa.RecordBatch.from_pylist([dict(zip(target.names, r)) for r in rows], target)
        action.start()
        for b in batches:
            if rows := [o for r in zip(*(c.to_pylist() for c in b.columns)) for o in action.process(r)]:
                yield out(rows)
        if rows := list(action.stop()):
            yield out(rows)

    return df.mapInArrow(run, schema)


def gather(df: DataFrame, make: Callable[[], Action], *keys: str, job: Job | None = None) -> dict[str, list]:
    """Runs an action over all rows and returns for each key the objects that partitions have put, in order of
    partition: one a partition and key at most. The rows that it gives are dropped. A partition that runs anew after a
    lost executor counts once."""
    import pickle

    context = _contexts(df, job)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        action = make()
        action.context = context()
        action.start()
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                for _ in action.process(r):
                    pass
        for _ in action.stop():
            pass
        rows = [{"at": TaskContext.get().partitionId(), "key": k, "object": pickle.dumps(action.context.own[k])} for k in keys if k in action.context.own]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("at", pa.int32()), ("key", pa.string()), ("object", pa.binary())]))

    rows = sorted(df.mapInArrow(run, "at int, key string, object binary").collect(), key=lambda r: r["at"])
    return {k: [pickle.loads(bytes(r["object"])) for r in rows if r["key"] == k] for k in keys}


@dataclass
class Job:
    """Steps that wait for tokens of others and give theirs when they end; properties are there for all, and so are
    shared objects: a step puts them, later steps and the actions that they apply() with this job get them."""

    properties: dict[str, str] = field(default_factory=dict)
    steps: list[tuple[Callable[[Job], object], tuple[str, ...], str | None]] = field(default_factory=list)
    results: dict[str, object] = field(default_factory=dict)
    shared: dict[str, object] = field(default_factory=dict)

    def put(self, key: str, value: object) -> Job:
        self.shared[key] = value
        return self

    def get(self, key: str, default: object = None) -> object:
        return self.shared.get(key, default)

    def step(self, run: Callable[[Job], object], waits_for: tuple[str, ...] = (), notifies: str | None = None) -> Job:
        self.steps.append((run, waits_for, notifies))
        return self

    def run(self) -> dict[str, object]:
        """Independent steps run side by side. The first failure ends the job."""
        done = {t: threading.Event() for _, _, t in self.steps if t}
        if missing := {w for _, ws, _ in self.steps for w in ws} - set(done):
            raise ValueError(f"nobody notifies {sorted(missing)}")
        failed: list[BaseException] = []

        def one(run, waits, token):
            try:
                for w in waits:
                    done[w].wait()
                if not failed:
                    self.results[token or f"step{len(self.results)}"] = run(self)
            except BaseException as e:  # noqa: BLE001
                failed.append(e)
            finally:
                if token:
                    done[token].set()

        threads = [threading.Thread(target=one, args=s) for s in self.steps]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if failed:
            raise failed[0]
        return self.results
