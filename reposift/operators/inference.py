"""Calling a user-given model function from tasks; failures are rows, never failed tasks."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reposift.operators.failures import BACKOFF_MS, LONGEST_HINT, TRANSIENT

BATCH = 16
TRIES = 3
#: Rows that leave a task together, about.
ROWS_OUT = 1024


class ModelError(Exception):
    """A failure with a kind (see failures.TRANSIENT) and perhaps the seconds that the service asks to wait."""

    def __init__(self, kind: str, message: str = "", retry_after: float | None = None):
        super().__init__(message or kind)
        self.kind, self.retry_after = kind, retry_after

    def __reduce__(self):
        return ModelError, (self.kind, str(self), self.retry_after)


def wait_ms(error: Exception, attempt: int) -> float:
    hint = getattr(error, "retry_after", None)
    if isinstance(hint, int | float) and 0 < hint <= LONGEST_HINT:
        return hint * 1000
    return BACKOFF_MS[min(attempt, len(BACKOFF_MS) - 1)]


def call(fn: Callable[[list], list], inputs: list, tries: int, sleep: Callable[[float], None]) -> tuple[list | None, int, Exception | None]:
    """The function's outputs, the number of tries, and the error that ended them; retries what may pass. A wrong number of outputs is an error."""
    for attempt in range(tries):
        try:
            out = fn(inputs)
            if len(out) != len(inputs):
                raise ModelError("bad_output", f"{len(out)} outputs for {len(inputs)} inputs")
            return out, attempt + 1, None
        except Exception as error:
            if getattr(error, "kind", None) not in TRANSIENT or attempt + 1 == tries:
                return None, attempt + 1, error
            sleep(wait_ms(error, attempt) / 1000)
    raise AssertionError


def outcomes(fn: Callable[[list], list], inputs: list, tries: int, halve: bool, sleep: Callable[[float], None]) -> Iterator[tuple]:
    """(output, status, error_kind, error_message, tries) of each input. With halve a refused batch is cut in half, down to single inputs."""
    out, n, error = call(fn, inputs, tries, sleep)
    if error is None:
        yield from ((x, "done", None, None, n) for x in out)
        return
    kind = getattr(error, "kind", None)
    if halve and kind == "bad_request" and len(inputs) > 1:
        middle = len(inputs) // 2
        for part in (inputs[:middle], inputs[middle:]):
            yield from outcomes(fn, part, tries, halve, sleep)
    else:
        yield from ((None, "failed", kind, str(error), n) for _ in inputs)


class Ledger:
    """What a task's calls have given so far, by the content of the input; an attempt that follows a lost one, or a later run, reads it before calling.

    One file for each attempt of a task, in a folder that all executors mount.
    Inputs are dealt by their content, so that a later run looks where an
    earlier one wrote. Each finished batch is on disk before the next is called.
    """

    def __init__(self, folder: str, part: int, attempt: int):
        folder = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(folder, exist_ok=True)
        self.path = os.path.join(folder, f"part-{part}-{attempt}-{uuid.uuid4().hex}.jsonl")
        self.known: dict[str, tuple] = {}
        for name in sorted(os.listdir(folder)):
            if name.startswith(f"part-{part}-"):
                with open(os.path.join(folder, name), encoding="utf-8") as lines:
                    for line in lines:
                        if line.endswith("\n"):  # a line that its writer did not finish is no answer
                            key, found = json.loads(line)
                            self.known[key] = tuple(found)

    @staticmethod
    def key(value: object) -> str:
        if hasattr(value, "asDict"):
            value = value.asDict()
        return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()

    def add(self, keys: list[str], found: list[tuple]) -> None:
        """Note what succeeded; failures may be tried again."""
        lines = [json.dumps([k, list(x)]) + "\n" for k, x in zip(keys, found, strict=True) if x[1] == "done"]
        with open(self.path, "a", encoding="utf-8") as out:
            out.writelines(lines)
            out.flush()
            os.fsync(out.fileno())


def paced(fn: Callable[[list], list], seconds: float, sleep: Callable[[float], None], clock: Callable[[], float] = time.monotonic) -> Callable[[list], list]:
    """fn, called at most once in so many seconds."""
    free = [clock()]

    def call_later(inputs: list) -> list:
        wait = free[0] - clock()
        if wait > 0:
            sleep(wait)
        free[0] = max(free[0], clock()) + seconds
        return fn(inputs)

    return call_later


def infer(
    rows: DataFrame, fn: Callable[[list], list], inputs: str, output: str, kind: str, batch: int = BATCH, tries: int = TRIES,
    halve: bool = True, in_flight: int | None = None, sleep: Callable[[float], None] = time.sleep, ledger: str | None = None, per_second: float | None = None,
) -> DataFrame:
    """rows with output (of SQL type kind), status, error_kind, error_message and tries.

    fn gets a list of at most batch inputs and returns as many outputs.
    in_flight bounds the tasks that call it at once, and per_second the calls of
    all of them together: each task has its share. ledger is a folder that all
    executors mount, one for each model: inputs that were answered there before
    are not sent again. Write the result before using it twice.
    """
    if per_second and not in_flight:
        raise ValueError("per_second needs in_flight, the number of tasks that share it")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{output}` {kind}", "status string, error_kind string, error_message string, tries int"])

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        book = Ledger(ledger, task.partitionId(), task.taskAttemptId()) if ledger else None
        model = paced(fn, in_flight / per_second, sleep) if per_second else fn

        def answers(values: list) -> list[tuple]:
            if book is None:
                return list(outcomes(model, values, tries, halve, sleep))
            keys = [book.key(x) for x in values]
            todo = list(dict.fromkeys(k for k in keys if k not in book.known))
            first = {k: x for k, x in reversed(list(zip(keys, values, strict=True)))}
            new = list(outcomes(model, [first[k] for k in todo], tries, halve, sleep)) if todo else []
            book.add(todo, new)
            book.known.update((k, x) for k, x in zip(todo, new, strict=True) if x[1] == "done")
            missed = dict(zip(todo, new, strict=True))
            return [book.known.get(k) or missed[k] for k in keys]

        step = max(1, ROWS_OUT // batch) * batch
        for part in parts:
            for lo in range(0, len(part), step):
                own = part.iloc[lo : lo + step].reset_index(drop=True)
                values = own[inputs].tolist()
                found = [x for k in range(0, len(values), batch) for x in answers(values[k : k + batch])]
                made = pd.DataFrame(found, columns=[output, "status", "error_kind", "error_message", "tries"])
                yield pd.concat((own, made), axis=1)

    if ledger:
        rows = rows.repartition(in_flight or rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64(inputs))
    elif in_flight:
        rows = rows.repartition(in_flight)
    return rows.mapInPandas(run, schema)


def chat(rows: DataFrame, fn: Callable[[list], list], system: str, user: str, **options) -> DataFrame:
    """rows with reply. system and user are columns with the two prompts; equal pairs are asked once and the reply is joined back."""
    asked = rows.select(F.struct(F.col(system).alias("system"), F.col(user).alias("user")).alias("__prompt")).distinct()
    pairs = lambda batch: fn([(x["system"], x["user"]) for x in batch])
    replies = infer(asked, pairs, "__prompt", "reply", "string", halve=False, **options)
    flat = replies.select(F.col("__prompt.system").alias(system), F.col("__prompt.user").alias(user), "reply", "status", "error_kind", "error_message", "tries")
    return rows.join(flat, [system, user], "left")
