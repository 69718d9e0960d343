"""Batch completion over HTTP (I1, I2): bounded pools, kept-alive connections, a journal of replies.

Only request ids and bodies go through Python.  Requests are dealt to a fixed
number of partitions by their id, so a task that is run again holds the same
requests.  A task sends up to ``pool`` requests at a time over connections that
stay open, and hands its replies on a few rows at a time.

Every reply that came is written to a journal in shared storage before it is
handed on.  A task that runs again (a lost executor, a failed job that is
started anew with the same journal) reads its part of the journal first and
sends only what is not there: at most the few replies on their way when the
task was lost are billed twice, each with an attempt id of its own.
"""

from __future__ import annotations

import http.client
import json
import os
import threading
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.operators import inference as I
from quillframe.operators import requests as Q
from quillframe.session import scratch_path, ship_package

RETRYABLE_STATUS = {408, 409, 425, 429, 500, 502, 503, 504}

REPLY_SCHEMA = "request_id string, attempt_id string, raw string, latency_ms double, error string, retries int, started_at timestamp"


class KeepAliveTransport:
    """POST over one open connection per thread and host; returns (status, body).

    A connection that the other side has closed in the meantime is opened
    again, once; other network errors are the caller's to retry.
    """

    def __init__(self) -> None:
        self._local = threading.local()

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self._local = threading.local()

    def __call__(self, url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> tuple[int, bytes]:
        parts = urllib.parse.urlsplit(url)
        open_ = self._local.__dict__.setdefault("open", {})
        key = (parts.scheme, parts.netloc, timeout)
        path = parts.path + (f"?{parts.query}" if parts.query else "")
        for fresh in (key not in open_, True):
            if fresh:
                kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                open_[key] = kind(parts.netloc, timeout=timeout)
            try:
                open_[key].request("POST", path, body=body, headers=dict(headers))
                reply = open_[key].getresponse()
                return reply.status, reply.read()
            except (http.client.RemoteDisconnected, http.client.CannotSendRequest, BrokenPipeError, ConnectionResetError):
                open_.pop(key).close()
                if fresh:
                    raise
            except Exception:
                open_.pop(key).close()
                raise
        raise AssertionError("unreachable")


class ReplyJournal:
    """Replies by partition, as small JSON-lines files under one folder that all executors see."""

    def __init__(self, uri: str) -> None:
        self.uri = uri.rstrip("/")

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.uri:
            return pafs.FileSystem.from_uri(self.uri)
        # a Hadoop path without an authority, or a plain one
        return pafs.LocalFileSystem(), self.uri.removeprefix("file:")

    def read(self, partition: int) -> dict[str, dict]:
        fs, base = self._open()
        found: dict[str, dict] = {}
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/{partition}", allow_not_found=True)):
            if info.is_file and info.base_name.endswith(".jsonl"):
                with fs.open_input_stream(info.path) as f:
                    for line in f.read().decode("utf-8").splitlines():
                        reply = json.loads(line)
                        found.setdefault(reply["request_id"], reply)
        return found

    def write(self, partition: int, replies: list[dict]) -> None:
        """One file, complete under its final name or not there at all."""
        fs, base = self._open()
        fs.create_dir(f"{base}/{partition}", recursive=True)
        name = f"{base}/{partition}/{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.part") as f:
            f.write("".join(json.dumps(r) + "\n" for r in replies).encode("utf-8"))
        fs.move(f"{name}.part", f"{name}.jsonl")


@dataclass
class HttpCompleter(I.Completer):
    """I1/I2 against an OpenAI-compatible ``/chat/completions`` endpoint.

    Retries cover connect errors, timeouts and status 408/409/425/429/5xx with
    exponential backoff ``retry_delay_s * 2**attempt``; other statuses fail at
    once.  A failing call becomes an error row, never a failed task.  The key
    is read from the environment variable ``api_key_env`` on executors.
    ``partitions`` and ``pool`` bound the calls under way.  ``journal`` names a
    folder in shared storage (default: a fresh one under the checkpoint
    folder); give the same folder again to resume a job that failed.
    """

    base_url: str
    api_key_env: str = ""
    auth_style: str = "bearer"
    timeout_s: float = 120.0
    max_retries: int = 3
    retry_delay_s: float = 1.0
    partitions: int | None = None
    pool: int = 8
    yield_rows: int = 32
    journal: str | None = None
    transport: Callable[[str, bytes, Mapping[str, str], float], tuple[int, bytes]] = KeepAliveTransport()
    sleep: Callable[[float], None] = time.sleep
    deterministic: bool = False
    needs = ("request_id", "payload")

    @classmethod
    def from_settings(cls, settings: Q.LLMSettings, presets: list[tuple] | None = None, **kw) -> HttpCompleter:
        """R5 in the request path: endpoint, auth style and key variable of the resolved provider."""
        r = Q.resolved_settings(settings, presets)
        return cls(r.base_url, r.api_key_env, r.auth_style, r.timeout_s, r.max_retries, r.retry_delay_s, **kw)

    def _headers(self) -> dict[str, str]:
        key = os.environ.get(self.api_key_env, "") if self.api_key_env else ""
        h = {"Content-Type": "application/json"}
        if self.auth_style == "bearer":
            h["Authorization"] = f"Bearer {key}"
        else:
            h["api-key"] = key
        return h

    def call_one(self, payload: str) -> tuple[str | None, float, str | None, int]:
        """(body, latency in ms, error, retries) of one request, retries included."""
        url = self.base_url.rstrip("/") + "/chat/completions"
        headers = self._headers()
        body = payload.encode("utf-8")
        attempts = max(1, self.max_retries)
        errors: list[str] = []
        start = time.monotonic()
        for attempt in range(attempts):
            try:
                status, data = self.transport(url, body, headers, self.timeout_s)
            except Exception as e:  # noqa: BLE001 - connect errors and timeouts are retried
                errors.append(f"{type(e).__name__}: {e}")
                retry = True
            else:
                if 200 <= status < 300:
                    text = data.decode("utf-8", errors="replace")
                    try:
                        json.loads(text)
                    except ValueError:
                        return None, (time.monotonic() - start) * 1000, "invalid JSON response", attempt
                    return text, (time.monotonic() - start) * 1000, None, attempt
                errors.append(f"HTTP {status}: {data[:200].decode('utf-8', errors='replace')}")
                retry = status in RETRYABLE_STATUS
            if not retry or attempt == attempts - 1:
                break
            self.sleep(self.retry_delay_s * (2**attempt))
        return None, (time.monotonic() - start) * 1000, errors[-1], len(errors) - 1

    def _reply(self, request_id: str, payload: str) -> dict:
        started = time.time_ns() // 1000
        raw, latency, error, retries = self.call_one(payload)
        return {
            "request_id": request_id, "attempt_id": uuid.uuid4().hex, "raw": raw, "latency_ms": float(latency),
            "error": error, "retries": int(retries), "started_at": started,
        }

    def send(self, partition: int, batches: Iterator[pd.DataFrame], journal: ReplyJournal) -> Iterator[pd.DataFrame]:
        """The replies to one partition's requests (request_id, payload), journalled ones first-hand."""
        known = journal.read(partition)
        with ThreadPoolExecutor(self.pool) as pool:
            for pdf in batches:
                for at in range(0, len(pdf), self.yield_rows):
                    part = list(zip(pdf["request_id"].iloc[at : at + self.yield_rows], pdf["payload"].iloc[at : at + self.yield_rows], strict=True))
                    new = list(pool.map(lambda r: self._reply(*r), [r for r in part if r[0] not in known]))
                    if new:
                        # failed calls cost nothing and may be tried again
                        journal.write(partition, [r for r in new if r["error"] is None])
                    rows = new + [known[i] for i, _ in part if i in known]
                    out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY_SCHEMA.split(", ")])
                    out["started_at"] = pd.to_datetime(out["started_at"], unit="us")
                    yield out

    def replies(self, requests: DataFrame, name: str = "any") -> DataFrame:
        """Send ``requests`` (request_id, payload) and return the written replies."""
        spark = requests.sparkSession
        ship_package(spark)
        journal = ReplyJournal(self.journal or scratch_path(spark, f"journal-{name}"))
        parts = self.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        completer = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from completer.send(TaskContext.get().partitionId(), batches, journal)

        dealt = requests.select("request_id", "payload").repartition(parts, "request_id")
        return I.materialize(dealt.mapInPandas(run, REPLY_SCHEMA), f"replies-{name}")

    def complete(self, requests: DataFrame, stage: str | None = None) -> DataFrame:
        return requests.join(self.replies(requests, stage or "any"), "request_id", "left")
