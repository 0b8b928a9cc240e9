"""Progress counters, throughput and a token bucket; driver- or task-side Python, no Spark inside."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

PHASES = ("scanning", "uploading", "complete", "error")


@dataclass(frozen=True)
class Progress:
    source_id: int = 0
    source_name: str = ""
    phase: str = "scanning"
    total_files: int = 0
    processed_files: int = 0
    new_files: int = 0
    unchanged_files: int = 0
    total_bytes: int = 0
    uploaded_bytes: int = 0
    bytes_per_second: float = 0.0
    eta_seconds: float = 0.0
    current_file: str = ""


class Tracker:
    """Counters behind a lock; the callback gets a snapshot after each change, outside of it."""

    def __init__(self, source_id: int = 0, source_name: str = "", callback: Callable[[Progress], None] | None = None, clock: Callable[[], float] = time.monotonic):
        self._lock, self._callback, self._clock, self._start = threading.Lock(), callback, clock, clock()
        self._now = Progress(source_id, source_name)

    def _update(self, **changes) -> Progress:
        with self._lock:
            self._now = now = replace(self._now, **{k: v(self._now) if callable(v) else v for k, v in changes.items()})
        if self._callback:
            self._callback(now)
        return now

    def set_phase(self, phase: str) -> Progress:
        return self._update(phase=phase)

    def set_total(self, files: int, size: int) -> Progress:
        return self._update(total_files=files, total_bytes=size)

    def file_processed(self, name: str, uploaded: int, is_new: bool) -> Progress:
        elapsed = max(self._clock() - self._start, 1e-9)

        def rate(p: Progress) -> float:
            return (p.uploaded_bytes + uploaded) / elapsed

        def eta(p: Progress) -> float:
            left = p.total_bytes - p.uploaded_bytes - uploaded
            return left / rate(p) if left > 0 and rate(p) > 0 else p.eta_seconds

        return self._update(
            current_file=name, bytes_per_second=rate, eta_seconds=eta, processed_files=lambda p: p.processed_files + 1, uploaded_bytes=lambda p: p.uploaded_bytes + uploaded,
            new_files=lambda p: p.new_files + is_new, unchanged_files=lambda p: p.unchanged_files + (not is_new),
        )

    def get(self) -> Progress:
        with self._lock:
            return self._now


class TokenBucket:
    """Bytes per second: a burst of one second at the start, at most two seconds' worth, refilled ten times a second.
    A rate of 0 means no limit. Time comes from ``clock`` and passes by ``sleep``, so tests need not wait."""

    def __init__(self, rate: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self._rate, self._bucket, self._most = max(rate, 0), max(rate, 0), 2 * max(rate, 0)
        self._clock, self._sleep, self._last, self._lock = clock, sleep, clock(), threading.Lock()

    def set_rate(self, rate: int) -> None:
        with self._lock:
            self._rate, self._most = max(rate, 0), 2 * max(rate, 0)
            self._bucket = min(self._bucket, self._most)

    def _refill(self) -> None:
        ticks = int((self._clock() - self._last) * 10 + 1e-9)
        if ticks > 0:
            self._bucket = min(self._most, self._bucket + ticks * (self._rate // 10))
            self._last += ticks / 10

    def wait(self, n: int) -> None:
        while n > 0:
            with self._lock:
                if self._rate <= 0:
                    return
                self._refill()
                taken = min(n, self._bucket)
                self._bucket -= taken
                n -= taken
            if n > 0:
                self._sleep(0.05)


class ThrottledReader:
    """Waits after each read for what it got."""

    def __init__(self, source, bucket: TokenBucket):
        self.source, self.bucket = source, bucket

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(n)
        self.bucket.wait(len(data))
        return data


class ThrottledWriter:
    """Waits before each write for what it will put."""

    def __init__(self, sink, bucket: TokenBucket):
        self.sink, self.bucket = sink, bucket

    def write(self, data: bytes) -> int:
        self.bucket.wait(len(data))
        return self.sink.write(data)
