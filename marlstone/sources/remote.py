"""Fetching documents. Spark deals the list; each partition fetches through one session at a polite pace."""

from __future__ import annotations

import heapq
import os
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import unwrap_url

#: Statuses that are worth another try.
RETRY_STATUS = (403, 429, 500, 502, 503, 504)
Fetch = Callable[[str], Iterator[bytes]]


class Retry(Exception):
    """Raised by a fetcher for a status of RETRY_STATUS; ``after`` is the wait in seconds that the host asks for, if it does."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def http_session(headers: dict[str, str] | None = None, connect_s: float = 10.0, chunk: int = 1 << 16) -> Callable[[], Fetch]:
    """Sessions over HTTP with fixed headers. ``connect_s`` bounds the wait for a connection and for each piece of the answer; statuses of RETRY_STATUS
    raise ``Retry``, others their error."""

    def session() -> Fetch:
        def fetch(url: str) -> Iterator[bytes]:
            try:
                answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=connect_s)
            except urllib.error.HTTPError as e:
                if e.code in RETRY_STATUS:
                    after = e.headers.get("Retry-After", "")
                    raise Retry(f"status {e.code}", float(after) if after.isdigit() else None) from e
                raise
            with answer:
                while piece := answer.read(chunk):
                    yield piece

        return fetch

    return session


class FolderSink:
    """Puts documents into a folder that all machines share: a part file that takes the document's name when it is whole."""

    def __init__(self, folder: str, suffix: str = ""):
        self.folder, self.suffix = folder, suffix

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name.replace("/", "_") + self.suffix)

    def exists(self, name: str) -> bool:
        return os.path.exists(self._path(name))

    def put(self, name: str, chunks: Iterator[bytes]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self._path(name)}.part", "wb") as f:
            for c in chunks:
                f.write(c)
        os.replace(f"{self._path(name)}.part", self._path(name))

    def drop(self, name: str) -> None:
        if os.path.exists(f"{self._path(name)}.part"):
            os.remove(f"{self._path(name)}.part")


class Pace:
    """When a host may be asked: a bucket of ``burst`` tokens that fills at ``rate`` a second; a request takes one."""

    def __init__(self, rate: float, burst: int, now: float):
        self.rate, self.burst, self.tokens, self.at, self.not_before = rate, burst, float(burst), now, now

    def ready(self) -> float:
        return max(self.not_before, self.at + max(0.0, 1.0 - self.tokens) / self.rate)

    def take(self, now: float) -> None:
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate) - 1.0
        self.at = now


def polite_order(jobs: Iterator[tuple], host: Callable[[tuple], str], rate: float, burst: int, window: int, clock: Callable[[], float], sleep: Callable[[float], None]):
    """Jobs as they may run: of at most ``window`` that are held, the one whose host is ready first. The caller sends True back for a job that is
    done, or the seconds after which it is to be tried again; its host waits as long, other hosts don't."""
    queues: dict[str, deque] = {}
    paces: dict[str, Pace] = {}
    heap: list[tuple[float, str]] = []
    held, more = 0, iter(jobs)
    while True:
        while held < window and (job := next(more, None)) is not None:
            name = host(job)
            if name not in queues:
                queues[name] = deque()
                paces.setdefault(name, Pace(rate, burst, clock()))
                heapq.heappush(heap, (paces[name].ready(), name))
            queues[name].append(job)
            held += 1
        if not heap:
            return
        at, name = heapq.heappop(heap)
        if at > clock():
            sleep(at - clock())
        paces[name].take(clock())
        job = queues[name].popleft()
        again = yield job
        if again is True:
            held -= 1
        else:
            queues[name].appendleft(job)
            paces[name].not_before = clock() + again
        if queues[name]:
            heapq.heappush(heap, (paces[name].ready(), name))
        else:
            del queues[name]


def fetch_by_host(
    jobs: DataFrame, session: Callable[[], Fetch], put: Callable[[str, Iterator[bytes]], None], exists: Callable[[str], bool] = lambda name: False,
    drop: Callable[[str], None] = lambda name: None, partitions: int = 64, rate: float = 2.0, burst: int = 4, window: int = 1024, attempts: int = 3, backoff_s: float = 1.0,
    budget_s: float | None = None, viewer: tuple[str, str, str] | None = None, overwrite: bool = False, timer: Callable[[], tuple] = lambda: (time.monotonic, time.sleep),
) -> DataFrame:
    """``doc_name, doc_link, status, error, attempts`` of every job, as ``fetch_documents``, but polite to each host: all links of a host are dealt
    to one task, which keeps to ``rate`` requests a second (``burst`` at once after a rest), waits as long as a failed answer asks for (or
    ``backoff_s``, doubled each time), and asks other hosts meanwhile. ``timer`` gives a clock and a sleep."""

    def run(batches):
        clock, sleep = timer()
        fetch, tried = session(), {}
        rows = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py(), k) for k, b, i in _numbered(batches))
        out: list[tuple] = []

        def within(chunks: Iterator[bytes], until: float | None) -> Iterator[bytes]:
            for c in chunks:
                if until is not None and clock() > until:
                    raise TimeoutError(f"not done within {budget_s} s")
                yield c

        def batch():
            kinds = [pa.string()] * 4 + [pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_name", "doc_link", "status", "error", "attempts"])
            out.clear()
            return made

        def wanted():
            for job in rows:
                if not overwrite and exists(job[0]):
                    out.append((job[0], job[1], "skipped", None, 0))
                else:
                    yield job

        order = polite_order(wanted(), lambda j: j[3] or "", rate, burst, window, clock, sleep)
        job = next(order, None)
        while job is not None:
            name, shown, link, _, k = job
            n = tried[k] = tried.get(k, 0) + 1
            again: bool | float = True
            try:
                put(name, within(fetch(link), budget_s and clock() + budget_s))
                out.append((name, shown, "downloaded", None, n))
            except Exception as e:
                drop(name)
                if isinstance(e, Retry) and n < attempts:
                    again = e.after if e.after is not None else backoff_s * 2 ** (n - 1)
                else:
                    out.append((name, shown, "failed", str(e), n))
            if again is True:
                del tried[k]
            if len(out) >= 1024:
                yield batch()
            try:
                job = order.send(again)
            except StopIteration:
                job = None
        yield batch()

    link = unwrap_url(F.col("doc_link"), *viewer) if viewer else F.col("doc_link")
    host = F.lower(F.coalesce(F.try_parse_url(link, F.lit("HOST")), F.lit("")))
    dealt = jobs.select(F.col("doc_name").cast("string").alias("doc_name"), "doc_link", link.alias("to"), host.alias("host")).repartition(partitions, "host")
    return dealt.mapInArrow(run, "doc_name string, doc_link string, status string, error string, attempts int")


def _numbered(batches) -> Iterator[tuple]:
    k = 0
    for b in batches:
        for i in range(b.num_rows):
            yield k, b, i
            k += 1


def fetch_documents(
    jobs: DataFrame, session: Callable[[], Fetch], put: Callable[[str, Iterator[bytes]], None], exists: Callable[[str], bool] = lambda name: False,
    partitions: int = 4, delay_s: float = 0.3, attempts: int = 3, backoff_s: float = 1.0, viewer: tuple[str, str, str] | None = None,
    budget_s: float | None = None, drop: Callable[[str], None] = lambda name: None, overwrite: bool = False,
) -> DataFrame:
    """``doc_name, doc_link, status, error`` of every job.

    ``session`` makes a fetcher (url to chunks of bytes) once per partition; ``put`` stores a stream under a name, whole
    or not at all; after a failure ``drop`` removes what is left of it. A stream that takes longer than ``budget_s`` fails.
    Names that exist are skipped, unless ``overwrite``. ``viewer`` (host, path, parameter) names a viewer page whose parameter
    holds the real address."""

    def within(chunks: Iterator[bytes], until: float | None) -> Iterator[bytes]:
        for c in chunks:
            if until is not None and time.monotonic() > until:
                raise TimeoutError(f"not done within {budget_s} s")
            yield c

    def run(batches):
        fetch = None
        for b in batches:
            status, errors = [], []
            for name, link in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if not overwrite and exists(name):
                    status.append("skipped")
                    errors.append(None)
                    continue
                fetch = fetch or session()
                for k in range(attempts):
                    try:
                        put(name, within(fetch(link), budget_s and time.monotonic() + budget_s))
                        status.append("downloaded")
                        errors.append(None)
                        break
                    except Exception as e:
                        drop(name)
                        if k + 1 == attempts or not isinstance(e, Retry):
                            status.append("failed")
                            errors.append(str(e))
                            break
                        time.sleep(backoff_s * 2**k)
                time.sleep(delay_s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(status, pa.string()), pa.array(errors, pa.string())], names=["doc_name", "doc_link", "status", "error"])

    link = unwrap_url(F.col("doc_link"), *viewer) if viewer else F.col("doc_link")
    dealt = jobs.select(F.col("doc_name").cast("string").alias("doc_name"), "doc_link", link.alias("to")).repartition(partitions, "doc_name")
    return dealt.mapInArrow(run, "doc_name string, doc_link string, status string, error string")


def retried(report: DataFrame, catalog: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A report with its failed documents fetched again; ``fetch`` makes report rows of jobs. Rows that did not fail stay."""
    from marlstone.sources.catalog import retry_merge
    from marlstone.sources.tables import written

    failed = report.where("status = 'failed'").select("doc_name")
    again = written(fetch(catalog.join(failed, "doc_name", "left_semi")))
    return retry_merge(report, again.select(*report.columns))
