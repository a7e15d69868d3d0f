import json
import os

import pytest
from pyspark.sql import functions as F

from marlstone import schema
from marlstone.operators import ablation
from marlstone.sources import catalog, files, layout, remote


def test_catalog(spark):
    rows = [("a", "l1", "x", "A", "1", 0), ("a", None, "y", None, "2", 1), ("", "l", "x", "A", "1", 2), (None, "l", "x", "A", "1", 3), ("b", "", "x", "B", "1", 4)]
    df = spark.createDataFrame(rows, "doc_name string, doc_link string, doc_type string, company string, doc_period string, ord int")
    assert [tuple(r) for r in catalog.download_list(df, "ord").collect()] == [("a", "l1")]
    last = {r.doc_name: r for r in catalog.last_records(df, "ord").collect()}
    assert last["a"].doc_type == "y" and last["a"].company == "unknown" and last["a"].doc_link is None and set(last) == {"a", "b"}


def test_work_list_and_retry(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "doc_name string")
    jobs, rest = catalog.work_list(names("c", "a", "b", "d"), names("a", "b", "c"), names("a"), limit=1)
    assert [r.doc_name for r in jobs.collect()] == ["b"]
    assert {(r.doc_name, r.status) for r in rest.collect()} == {("d", "source_missing"), ("a", "skipped")}
    report = spark.createDataFrame([("a", "downloaded"), ("b", "failed"), ("c", "failed")], "doc_name string, status string")
    again = spark.createDataFrame([("b", "downloaded")], "doc_name string, status string")
    assert {tuple(r) for r in catalog.retry_merge(report, again).collect()} == {("a", "downloaded"), ("b", "downloaded"), ("c", "failed")}
    assert catalog.first_n(report, ["doc_name"], 0).count() == 3 and catalog.first_n(report, ["doc_name"], 2).count() == 2


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "c")
    os.mkdir(path)
    with open(f"{path}/a.jsonl", "w", encoding="utf-8") as f:
        f.write(json.dumps({"chunk_id": "d__p0000__c0000", "doc_name": "d", "doc_period": 2018, "text": "é", "structured": {"row_range": [0, 4], "rows": [{"row_label": "x", "value": 1.5}]}}, ensure_ascii=False) + "\n\n")
    got = files.read_chunks(spark, path).collect()
    assert len(got) == 1 and got[0].doc_period == "2018" and got[0].structured.row_range == [0, 4] and got[0].text == "é" and got[0].section is None
    assert files.line_count(spark, path).first()[0] == 2 and files.read_chunks(spark, path, "other").count() == 0
    out = str(tmp_path / "o")
    files.write_jsonl(files.read_chunks(spark, path), out)
    files.write_jsonl(files.read_chunks(spark, path), out, append=True)
    assert files.read_chunks(spark, out).count() == 2
    with open(f"{path}/b.jsonl", "w") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):
        files.read_chunks(spark, path).collect()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", "failed", "no"), ("a", "ok", None)], "doc_name string, status string, error string")
    files.write_report(df, str(tmp_path / "r"), schema.EXTRACTION_REPORT)
    back = files.read_report(spark, str(tmp_path / "r"))
    assert back.columns == [f.name for f in schema.EXTRACTION_REPORT] and [r.doc_name for r in back.collect()] == ["a", "b"]
    files.write_json(spark, files.manifest("m", "exact", 3, 64), str(tmp_path / "m.json"))
    assert json.load(open(tmp_path / "m.json"))["n_chunks"] == 3


def test_fetching(spark, tmp_path):
    folder = str(tmp_path)

    def session():
        def fetch(url):
            if "bad" in url:
                raise ValueError("status 404")
            if "busy" in url:
                raise remote.Retry("status 503")
            return iter([b"a", b"b"])

        return fetch

    def put(name, chunks):
        with open(f"{folder}/{name}.part", "wb") as f:
            for c in chunks:
                f.write(c)
        os.rename(f"{folder}/{name}.part", f"{folder}/{name}")

    jobs = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "busy"), ("d", "x")], "doc_name string, doc_link string")
    open(f"{folder}/d", "w").write("there")
    got = {r.doc_name: (r.status, r.error) for r in remote.fetch_documents(jobs, session, put, lambda n: os.path.exists(f"{folder}/{n}"), delay_s=0, backoff_s=0).collect()}
    assert got == {"a": ("downloaded", None), "b": ("failed", "status 404"), "c": ("failed", "status 503"), "d": ("skipped", None)}
    assert open(f"{folder}/a").read() == "ab"


def test_layout_parser(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"hello")
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def parse(content):
        if content == b"!":
            raise ValueError("not a document")
        return {"spans": [{"page": 0, "page_height": 800.0, "block": 0, "line": 0, "span": 0, "text": content.decode(), "size": 10.0, "bold": False}], "toc": [{"level": 1, "title": "t", "page": 1}]}

    opened = layout.open_documents(layout.read_files(spark, f"{tmp_path}/*.pdf"), parse)
    assert {(r.doc_name, r.status) for r in opened.collect()} == {("good", "ok"), ("bad", "failed")}
    assert layout.layout_table(opened, "spans").first().text == "hello" and layout.layout_table(opened, "toc").count() == 1


def test_comparison_keeps_going(spark):
    good = spark.createDataFrame([(1, 0.5)], "i int, token_f1 double")

    class Bad:
        def withColumn(self, *_):
            raise RuntimeError("no model")

    running = good.withColumn("token_f1", F.raise_error(F.lit("died in a task")).cast("double"))
    table, failed = ablation.compare({"a": good, "b": Bad(), "c": lambda: good.withColumn("token_f1", F.lit(1.0)), "d": running})
    assert {(r.config, r.token_f1) for r in table.collect()} == {("a", 0.5), ("c", 1.0)} and failed["b"] == "no model"
    assert set(failed) == {"b", "d"} and "died in a task" in failed["d"]


def test_hosts_are_asked_politely():
    """On a simulated clock: no host is asked faster than its pace, a failing one waits alone, and all jobs are done in the least time."""
    now, log = [0.0], []
    jobs = [(f"{h}{i}", h) for i in range(12) for h in ("a", "b", "c")] + [("d0", "d")]
    order = remote.polite_order(iter(jobs), lambda j: j[1], rate=1.0, burst=2, window=10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    failed, job = set(), next(order)
    while True:
        log.append((now[0], *job))
        again = True
        if job[0] == "b3" and job[0] not in failed:
            failed.add("b3")
            again = 20.0
        try:
            job = order.send(again)
        except StopIteration:
            break
    assert sorted({n for _, n, _ in log}) == sorted(n for n, _ in jobs) and len(log) == len(jobs) + 1
    for h in "abcd":
        times = [t for t, _, x in log if x == h]
        assert all(len([u for u in times if t <= u < t + 1]) <= 2 for t in times)
        assert all(y - x >= 1 - 1e-9 for x, y in zip(times[1:], times[2:]) if h in "ac")  # b may catch up after its rest
    second = [t for t, n, _ in log if n == "b3"]
    assert second[1] - second[0] >= 20 and max(t for t, n, _ in log if n[0] == "a") < 25


def test_fetching_by_host_over_http(spark, tmp_path):
    """A real server: headers arrive, a 503 is tried again, a 404 is not, part files become documents or go."""
    import http.server
    import threading

    seen, hits = [], {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers["X-Who"])
            hits[self.path] = hits.get(self.path, 0) + 1
            code = 503 if self.path == "/b" and hits[self.path] == 1 else 404 if self.path == "/c" else 200
            self.send_response(code)
            if code == 503:
                self.send_header("Retry-After", "0")
            self.end_headers()
            if code == 200:
                self.wfile.write(b"x" * 200_000)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        sink = remote.FolderSink(str(tmp_path / "docs"), ".bin")
        sink.put("old", iter([b"1"]))
        jobs = spark.createDataFrame([(n, f"{url}/{n}") for n in ("a", "b", "c", "old")], "doc_name string, doc_link string")
        done = remote.fetch_by_host(jobs, remote.http_session({"X-Who": "me"}, connect_s=5), sink.put, sink.exists, sink.drop, partitions=2, rate=50.0)
        got = {r.doc_name: (r.status, r.attempts) for r in done.collect()}
        assert got == {"a": ("downloaded", 1), "b": ("downloaded", 2), "c": ("failed", 1), "old": ("skipped", 0)} and set(seen) == {"me"}
        assert sorted(os.listdir(tmp_path / "docs")) == ["a.bin", "b.bin", "old.bin"] and os.path.getsize(tmp_path / "docs" / "a.bin") == 200_000
    finally:
        server.shutdown()
