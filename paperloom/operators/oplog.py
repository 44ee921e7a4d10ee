"""Applying a rename plan: the plan is a distributed query; file effects run on the driver, as one transaction.

The plan is streamed to the driver (toLocalIterator), never collected whole, and logged before anything is touched. If an
operation fails, everything that the plan did is undone in reverse, from the log, and nothing further is tried.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..logs import get

log_of = get("oplog")
#: States of an operation in the log: planned, executed, undone.
PLANNED, EXECUTED, UNDONE = 0, 1, -1


class RollbackError(RuntimeError):
    """An operation could not be undone; those before it in the reverse order are logged as undone."""


def file_checksum(path: str | Path) -> str:
    """OP-7: hash of a whole file, read in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class Log:
    """An append-only file of JSON lines: the operations of a job by number, and their changes of state."""

    def __init__(self, path: str | Path, job_id: str):
        self.path, self.job_id = Path(path), job_id
        self.file = self.path.open("a", encoding="utf-8")

    def write(self, **row) -> None:
        self.file.write(json.dumps({"job_id": self.job_id, **row}) + "\n")

    def sync(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()

    def rows(self) -> Iterator[dict]:
        self.file.flush()
        with self.path.open(encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                if row["job_id"] == self.job_id:
                    yield row

    def executed(self) -> list[dict]:
        """Executed operations, the last first. Only those of one job are held: as many as the driver itself carried out."""
        ops, state = {}, {}
        for row in self.rows():
            if "operation" in row:
                ops[row["op"]] = row
            state[row["op"]] = row["executed"]
        return [ops[k] for k in sorted(ops, reverse=True) if state[k] == EXECUTED]

    def last_number(self) -> int:
        return max((row["op"] for row in self.rows()), default=0)


def _apply(op: dict) -> None:
    target = Path(op["target_path"])
    if op["operation"] == "mkdir":
        target.mkdir(parents=True, exist_ok=True)
        return
    if op["operation"] not in ("rename", "move"):
        raise ValueError(f"unknown operation {op['operation']}")
    source = Path(op["source_path"])
    if not source.exists():
        raise FileNotFoundError(source)
    if target.exists():
        raise FileExistsError(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(str(source), str(target))


def _undo(op: dict) -> None:
    target = Path(op["target_path"])
    if op["operation"] == "mkdir":
        if target.is_dir() and not any(target.iterdir()):
            target.rmdir()
        return
    if not target.exists():
        log_of.warning("nothing to bring back from %s", target)
        return
    Path(op["source_path"]).parent.mkdir(parents=True, exist_ok=True)
    shutil.move(str(target), op["source_path"])
    if target.parent.is_dir() and not any(target.parent.iterdir()):
        target.parent.rmdir()


def _undo_all(log: Log) -> tuple[int, str | None]:
    """(operations undone, error): in reverse; each is logged once it is undone, and the first failure ends it."""
    n = 0
    for op in log.executed():
        try:
            _undo(op)
        except OSError as e:
            log.sync()
            return n, f"operation {op['op']} ({op['target_path']}): {e}"
        log.write(op=op["op"], executed=UNDONE)
        n += 1
    log.sync()
    return n, None


def apply_plan(plan: DataFrame, log: str | Path, job_id: str = "manual", dry_run: bool = True) -> dict:
    """OP-2, OP-3: {total, executed, errors, dry_run}; plan has operation, source_path, target_path, and is applied in its order.

    A dry run only counts, on the executors. Else the whole plan is logged, then carried out; a failure undoes all of it."""
    if dry_run:
        return {"total": plan.agg(F.count("*").alias("n")).first().n, "executed": 0, "errors": 0, "dry_run": True}
    out = {"total": 0, "executed": 0, "errors": 0, "dry_run": False}
    book = Log(log, job_id)
    try:
        first = book.last_number() + 1
        for r in plan.toLocalIterator():
            book.write(op=first + out["total"], operation=r.operation, source_path=r.source_path, target_path=r.target_path, executed=PLANNED)
            out["total"] += 1
        book.sync()
        for op in book.rows():
            if "operation" not in op or op["op"] < first:
                continue
            try:
                _apply(op)
            except (OSError, ValueError) as e:
                log_of.error("operation %d failed (%s): the plan is undone", op["op"], e)
                done = [x for x in book.executed() if x["op"] >= first]
                for x in done:
                    try:
                        _undo(x)
                    except OSError as bad:
                        log_of.error("operation %d is not undone: %s", x["op"], bad)
                        continue
                    book.write(op=x["op"], executed=UNDONE)
                out.update(executed=0, errors=1)
                return out
            book.write(op=op["op"], executed=EXECUTED)
            book.sync()
            out["executed"] += 1
        return out
    finally:
        book.close()


def rollback(log: str | Path, job_id: str) -> int:
    """OP-5: undo the executed operations of a job in reverse; returns how many. What is undone is logged as it happens; a failure raises RollbackError."""
    book = Log(log, job_id)
    try:
        n, error = _undo_all(book)
    finally:
        book.close()
    if error:
        raise RollbackError(error)
    return n
