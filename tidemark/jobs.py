"""A queue of jobs as state transitions over a small stored table; each transition is one version, so that two workers can't take one job."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from tidemark.sources.store import Conflict, Store

SCHEMA = "job_id string, kind string, args_hash string, args string, state string, attempts int, max_attempts int, next_run_at double, result string, error string, created_at double, updated_at double"
#: Attempts of a job, seconds before the second one (doubled for each further one).
ATTEMPTS, BACKOFF_S = 3, 2.0


class Jobs:
    """States: queued, running, done, failed. The table is a control table: its active rows are few."""

    def __init__(self, store: Store, clock: Callable[[], float] = time.time):
        self.store, self.clock = store, clock

    def _rows(self) -> list[dict]:
        df = self.store.read("jobs")
        return [] if df is None else [r.asDict() for r in df.collect()]

    def _swap(self, change: Callable[[list[dict]], object]) -> object:
        """Applies a change to the table; tries again where another writer was first."""
        for _ in range(20):
            base = self.store.manifest("jobs")
            rows = [] if base is None else [r.asDict() for r in self.store._load("jobs", base).collect()]
            out = change(rows)
            df = self.store.spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
            try:
                self.store._commit("jobs", base, df, "job_id", None)
                return out
            except Conflict:
                continue
        raise Conflict("the queue is too busy")

    def enqueue(self, kind: str, args: dict | None = None, max_attempts: int = ATTEMPTS) -> str:
        """The id of a new job, or of the active one with the same kind and arguments."""
        text = json.dumps(args or {}, sort_keys=True)
        digest, now = hashlib.sha256(text.encode()).hexdigest(), self.clock()

        def change(rows: list[dict]) -> str:
            for r in rows:
                if (r["kind"], r["args_hash"]) == (kind, digest) and r["state"] in ("queued", "running"):
                    return r["job_id"]
            job = uuid.uuid4().hex
            rows.append({"job_id": job, "kind": kind, "args_hash": digest, "args": text, "state": "queued", "attempts": 0, "max_attempts": max_attempts, "next_run_at": now, "result": None, "error": None, "created_at": now, "updated_at": now})
            return job

        return self._swap(change)

    def claim(self) -> dict | None:
        """The oldest job that is due, now running, or None."""
        now = self.clock()

        def change(rows: list[dict]) -> dict | None:
            due = sorted((r for r in rows if r["state"] == "queued" and r["next_run_at"] <= now), key=lambda r: (r["next_run_at"], r["created_at"], r["job_id"]))
            if not due:
                return None
            due[0].update(state="running", attempts=due[0]["attempts"] + 1, updated_at=now)
            return dict(due[0])

        return self._swap(change)

    def finish(self, job_id: str, result: object) -> None:
        def change(rows: list[dict]) -> None:
            for r in rows:
                if r["job_id"] == job_id:
                    r.update(state="done", result=json.dumps(result, default=str), error=None, updated_at=self.clock())

        self._swap(change)

    def fail(self, job_id: str, error: str) -> None:
        """Queued again after a growing pause, or failed after the last attempt."""

        def change(rows: list[dict]) -> None:
            now = self.clock()
            for r in rows:
                if r["job_id"] == job_id:
                    again = r["attempts"] < r["max_attempts"]
                    r.update(state="queued" if again else "failed", error=error[:500], updated_at=now, next_run_at=now + BACKOFF_S * 2 ** (r["attempts"] - 1))

        self._swap(change)

    def recover(self) -> int:
        """Jobs that a crashed worker left running are queued again; returns their number."""

        def change(rows: list[dict]) -> int:
            left = [r for r in rows if r["state"] == "running"]
            for r in left:
                r.update(state="queued", next_run_at=self.clock(), updated_at=self.clock())
            return len(left)

        return self._swap(change)

    def status(self, job_id: str) -> dict | None:
        return next((r for r in self._rows() if r["job_id"] == job_id), None)

    def work(self, handlers: dict[str, Callable[..., object]], most: int = 100) -> int:
        """Runs due jobs one after the other, ``most`` at once; returns how many ran. A failing job does not stop the others."""
        for n in range(most):
            job = self.claim()
            if job is None:
                return n
            try:
                self.finish(job["job_id"], handlers[job["kind"]](**json.loads(job["args"])))
            except Exception as e:  # noqa: BLE001 - kept with the job
                self.fail(job["job_id"], f"{type(e).__name__}: {e}")
        return most
