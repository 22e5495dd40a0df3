"""The run ledger of a store: append-only records, audit events, latest state.

Records are JSON files, one for each run; a chain can only be extended in
order, by one writer.  They are read back as a table by Spark.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import platform
import socket
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession

from voxelloom.operators import ledger
from voxelloom.sources import sinks
from voxelloom.sources.formats import _read_text

#: Schemas of records, events and manifests.
RECORD_SCHEMA, EVENT_SCHEMA, MANIFEST_SCHEMA = "provenance.v1", "audit_event.v1", "audit_log_manifest.v1"


def now() -> str:
    return datetime.datetime.now(tz=datetime.UTC).isoformat()


def file_sha256(path: str, block: int = 1 << 20) -> str:
    """Hash of a local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


class RunLedger:
    """Runs below ``<root>/provenance``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _json(self, name: str, default=None):
        text = _read_text(self.spark, f"{self.root}/provenance/{name}.json")
        return json.loads(text) if text else default

    def _put(self, name: str, value) -> None:
        sinks.put(f"{self.root}/provenance/{name}.json", json.dumps(value, sort_keys=True).encode())

    def head(self) -> dict:
        """run_count, latest_run_id and latest_hash."""
        return self._json("head", {"run_count": 0, "latest_run_id": None, "latest_hash": None})

    def append(self, parameters: dict, steps: list[dict], outputs: dict, status: str = "completed", run_id: str | None = None,
               started: str | None = None, ended: str | None = None, audit_log: dict | None = None) -> str:
        """Adds a record at the end of the chain; its hash covers the hash before."""
        head, run_id = self.head(), (run_id or "").strip() or uuid.uuid4().hex
        record = {
            "schema": RECORD_SCHEMA, "run_id": run_id, "run_index": head["run_count"] + 1, "status": status,
            "timestamps": {"started_utc": started or now(), "ended_utc": ended or now()}, "workflow": {"parameters": parameters},
            "steps": steps, "outputs": outputs,
            "environment": {"python_version": platform.python_version(), "platform": platform.platform(), "machine": platform.machine(), "argv": list(sys.argv)},
            "hash_chain": {"prev_hash": head["latest_hash"]}, "storage_policy": {"provenance": "append_only", "analysis_outputs": "latest_only"},
        }
        if audit_log is not None:
            record["audit_log"] = audit_log
        self._seal(record)
        return run_id

    def _seal(self, record: dict) -> None:
        record["hash_chain"].pop("self_hash", None)
        record["hash_chain"]["self_hash"] = hashlib.sha256(ledger.canonical_json(record).encode()).hexdigest()
        self._put(f"runs/{record['run_index']:08d}-{record['run_id']}", record)
        self._put("head", {"run_count": record["run_index"], "latest_run_id": record["run_id"], "latest_hash": record["hash_chain"]["self_hash"], "updated_utc": now()})

    def records(self) -> list[dict]:
        """All records by index; a ledger has one small record for each run."""
        if not self.head()["run_count"]:
            return []
        rows = self.spark.read.text(f"{self.root}/provenance/runs", wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda r: r["run_index"])

    def table(self) -> DataFrame:
        return self.spark.read.json(f"{self.root}/provenance/runs", multiLine=True)

    def attach_manifest(self, run_id: str, audit_log: dict) -> None:
        """Adds a manifest to the latest run and seals it anew; earlier runs are closed."""
        head = self.head()
        if run_id != head["latest_run_id"]:
            raise ValueError(f"{run_id} is not the latest run")
        record = self.records()[-1]
        self._seal(record | {"audit_log": audit_log})

    def verify(self) -> tuple[bool, list[str]]:
        """Whether every hash and link holds, and what does not."""
        issues, previous = [], None
        for i, record in enumerate(self.records(), 1):
            chain = record["hash_chain"]
            body = record | {"hash_chain": {k: v for k, v in chain.items() if k != "self_hash"}}
            if record["run_index"] != i:
                issues.append(f"run {record['run_index']}: index gap")
            if chain.get("prev_hash") != previous:
                issues.append(f"run {record['run_index']}: prev_hash mismatch")
            if hashlib.sha256(ledger.canonical_json(body).encode()).hexdigest() != chain.get("self_hash"):
                issues.append(f"run {record['run_index']}: self_hash mismatch")
            previous = chain.get("self_hash")
        return not issues, issues

    def history(self, operation: str, parameters: dict | None = None) -> dict:
        """Whether the operation has completed, whether with these parameters, and by which runs."""
        done = [r for r in self.records() if step_completed(r, operation)]
        wanted = None if parameters is None else ledger.canonical_json(ledger.comparable(parameters))
        alike = [r for r in done if wanted is not None and ledger.canonical_json(ledger.comparable(step_parameters(r, operation))) == wanted]
        return {
            "has_run": bool(done), "matches": bool(alike), "latest_run_id": done[-1]["run_id"] if done else None,
            "matching_run_id": alike[-1]["run_id"] if alike else None,
        }

    def put_state(self, state: dict, source: str) -> None:
        """The latest state of the settings; the one before is replaced."""
        self._put("latest_state", {"state": state, "source": source, "updated_utc": now()})

    def state(self) -> dict | None:
        return (self._json("latest_state") or {}).get("state")

    def persist_events(self, path: str, run_id: str) -> str:
        """Copies an event log into the store, named by its run."""
        target = f"{self.root}/event_logs/{run_id}.jsonl"
        with open(path, "rb") as f:
            sinks.put(target, f.read())
        return target


def step_completed(record: dict, operation: str) -> bool:
    """A completed run whose first step of the operation was not skipped."""
    step = next((s for s in record.get("steps", []) if s.get("name") == operation), None)
    return record.get("status") == "completed" and step is not None and not step.get("skipped", False)


def step_parameters(record: dict, operation: str) -> dict:
    return next((s.get("parameters") or {} for s in record.get("steps", []) if s.get("name") == operation), {})


class AuditLog:
    """One JSON object for each event, appended to a local file and redacted."""

    def __init__(self, path: str, execution_id: str | None = None, run_id: str | None = None):
        self.path, self.execution_id, self.run_id, self.count = path, execution_id or uuid.uuid4().hex, run_id, 0

    def emit(self, event_type: str, level: str = "INFO", **fields) -> dict:
        self.count += 1
        event = {
            "schema": EVENT_SCHEMA, "sequence": self.count, "timestamp_utc": now(), "level": level, "event_type": event_type,
            "execution_id": self.execution_id, "run_id": self.run_id, "host": socket.gethostname(), "pid": os.getpid(),
        } | {k: ledger.redact(v) for k, v in fields.items() if v is not None}
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(ledger.canonical_json(event) + "\n")
        return event

    def manifest(self) -> dict:
        """Path, events, bytes and hash of the log."""
        return {
            "schema": MANIFEST_SCHEMA, "path": self.path, "execution_id": self.execution_id, "run_id": self.run_id,
            "event_count": self.count, "bytes": os.path.getsize(self.path), "sha256": file_sha256(self.path), "policy": "append_only",
        }


def text_log_events_path(path: str) -> str:
    """``<name>.events.jsonl`` beside a text log."""
    folder, name = os.path.split(path)
    return os.path.join(folder, f"{os.path.splitext(name)[0]}.events.jsonl")
