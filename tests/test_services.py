"""Outside services against a local server, sessions in a folder, table candidates, text in images."""

import json
import os
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from leafwork.operators import images, regions, tables, translate
from leafwork.plans.service import ConflictError, NotFoundError, Service
from leafwork.settings import Settings
from leafwork.sources import blocks, external, services

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><biblStruct coords="2,10,20,100,30;2,10,20,100,30"/></text></TEI>'


class Server(BaseHTTPRequestHandler):
    polls = 0

    def _reply(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode() if isinstance(body, str) else json.dumps(body).encode())

    def do_POST(self):
        self.rfile.read(int(self.headers.get("Content-Length", 0)))
        if self.path.startswith("/api/"):
            self._reply(200, TEI)
        elif self.headers.get("Authorization") != "Bearer secret":
            self._reply(403, "no")
        else:
            self._reply(200, {"data": {"jobId": "j1"}})

    def do_GET(self):
        if self.path == "/result":
            self._reply(200, json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": " The servers compute a sum of inputs "}}]}}) + "\n{bad\n")
            return
        Server.polls += 1
        host = self.headers["Host"]
        self._reply(*((503, "busy") if Server.polls == 1 else (200, {"data": {"state": "running"}}) if Server.polls == 2 else (200, {"data": {"state": "done", "resultUrl": {"jsonUrl": f"http://{host}/result"}}})))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_ocr_job(url):
    raw = services.ocr_job(b"png", f"{url}/jobs", "secret", "m", 5.0, 0.01, 20.0)
    assert "The servers" in raw
    with pytest.raises(services.ServiceError, match="http_403"):
        services.ocr_job(b"png", f"{url}/jobs", "wrong", "m", 5.0, 0.01, 1.0)


def test_remote_ocr_and_image_text(spark, url):
    os.environ.pop("NO_TOKEN", None)
    pics = spark.createDataFrame([(1, 1, 0, bytearray(b"png"))], "doc_id long, page_no int, image_index int, content binary")
    assert [r.reason for r in services.remote_ocr(pics, f"{url}/jobs", "NO_TOKEN").collect()] == ["remote_ocr_missing_token"]
    raw = json.dumps({"result": {"layoutParsingResults": [{"markdown": {"text": "The servers compute a sum of all the inputs"}}]}})
    remote = spark.createDataFrame([(1, 1, 0, raw), (1, 1, 1, raw)], "doc_id long, page_no int, image_index int, raw string")
    local = spark.createDataFrame([(1, 1, 0, ["Every party sends shares to the others", "no polygon"], [[[0.0, 0.0], [400.0, 40.0]]])], "doc_id long, page_no int, image_index int, rec_texts array<string>, rec_polys array<array<array<double>>>")
    sizes = spark.createDataFrame([(1, 1, 0, 500, 40), (1, 1, 1, 500, 40)], "doc_id long, page_no int, image_index int, width int, height int")
    lines = images.lines_of(local, remote, sizes)
    assert {(r.image_index, r.text[:5], r.x1) for r in lines.collect()} == {(0, "Every", 400), (1, "The s", 500)}
    out = images.translate_lines(lines, [translate.Stub("a", [None]), translate.Stub("b")], translate.Options()).collect()
    assert len(out) == 2 and all(r.reason is None and r.from_provider == "a" and r.to_provider == "b" and r.lines for r in out)
    failed = images.translate_lines(lines, [translate.Stub("a", [None])], translate.Options()).collect()
    assert all(r.reason.startswith("image_text_translation_failed") for r in failed)


def test_grobid(spark, url):
    files = spark.createDataFrame([(1, bytearray(b"%PDF"))], "doc_id long, content binary")
    got = regions.grobid_regions(external.tei_coordinates(services.grobid(files, url))).collect()
    assert [(r.page_no, round(r.x0, 3)) for r in got] == [(2, 22.222)]
    assert regions.grobid_regions(external.tei_coordinates(services.grobid(files, "http://127.0.0.1:1").dropna())).count() == 0


def test_detector(spark):
    def make():
        return lambda content: [{"res": [{"label": "Table", "coordinate": [1, 2, 30, 40]}, {"type": "reference", "points": [[1, 800], [90, 900]]}]}]

    pages = spark.createDataFrame([(1, 1, bytearray(b"x"))], "doc_id long, page_no int, content binary")
    hints = regions.layout_hints(external.layout_rects(services.detected(pages, "test", make), 1000.0, 1000.0))
    assert {(r.kind, r.x1) for r in hints.collect()} == {("table", 30.0), ("reference", 90.0)}

    def broken():
        raise RuntimeError("not installed")

    assert services.detected(pages, "broken", broken).count() == 0


def test_table_candidates(spark):
    w, h = 600.0, 800.0
    rows = [(1, 0, False, 50, 50, 300, 200, 5, 4), (2, 1, True, 51, 50, 300, 200, 5, 4), (3, 1, True, 0, 0, 600, 790, 9, 4), (4, 2, True, 10, 100, 200, 650, 9, 4), (5, 2, True, 320, 300, 580, 400, 5, 4)]
    c = spark.createDataFrame([(i, 1, 1, s, t, *map(float, r[:4]), *r[4:]) for i, s, t, *r in rows], "region_id int, doc_id long, page_no int, strategy int, by_text boolean, x0 double, y0 double, x1 double, y1 double, row_count int, col_count int")
    b = spark.createDataFrame([(1, 1, 330.0, 310.0, 570.0, 390.0, True, False, 60, 5)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, paragraph boolean, table boolean, words int, punct int")
    assert [tuple(r)[2:] for r in tables.found(c, b, w, h).collect()] == [(50.0, 50.0, 300.0, 200.0)]
    flags = spark.createDataFrame([(1, 1, 0, 50.0, 100.0, 300.0, 120.0, True, False, False, True), (1, 1, 1, 50.0, 250.0, 300.0, 290.0, False, False, True, False)], "doc_id long, page_no int, block_index int, x0 double, y0 double, x1 double, y1 double, caption boolean, note boolean, paragraph boolean, table boolean")
    clips = tables.caption_clips(flags, w, h)
    assert [(r.y0, r.y1) for r in clips.collect()] == [(118.0, 248.0)]
    inside = spark.createDataFrame([(1, 1, 0, 60.0, 130.0, 280.0, 240.0), (1, 1, 0, 60.0, 500.0, 280.0, 600.0)], "doc_id long, page_no int, caption_index int, x0 double, y0 double, x1 double, y1 double")
    found = tables.found_in_clips(inside, clips, w, h)
    assert found.count() == 1 and tables.first_of(found, found).count() == 1


def test_trimmed_tables(spark):
    t = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 400.0, 400.0), (2, 1, 1, 0.0, 500.0, 400.0, 560.0)], "region_id int, doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(1, 1, 10.0, 10.0, 390.0, 390.0, True, False, False, 60, 5), (1, 1, 10.0, 580.0, 390.0, 640.0, False, True, False, 9, 1)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, paragraph boolean, note boolean, table boolean, words int, punct int")
    assert [(r.region_id, r.y1) for r in regions.trimmed_tables(t, b, 600.0 * 800.0).collect()] == [(2, 561.0)]


def test_settings():
    assert Settings.load({}).options().max_blocks == 36
    s = Settings.load({"LEAFWORK_COMPAT": "true", "LEAFWORK_RENDER_DPI": "72", "LEAFWORK_COMPAT_BATCH_SEGMENT_CHAR_LIMIT": "10"})
    assert (s.batch_segment_size, s.batch_segment_char_limit, s.enable_single_block_fallback, s.zoom) == (18, 1200, True, 1.0)


def test_uploads(spark, tmp_path):
    for name, size in (("a.pdf", 10), ("b.PDF", 5), ("c.txt", 3), ("d.pdf", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    good, bad = blocks.uploads(spark, str(tmp_path))
    assert good.count() == 2 and {r.reason for r in bad.collect()} <= {"not_a_pdf", "empty"} and bad.count() >= 1


def test_block_text(spark):
    lines = [[("A−b ", 9.0, 0x010203), ("c", 12.0, 0)], [("next", 0.0, 0)]]
    df = spark.createDataFrame([(1, 1, 0, 0, 1.0, 2.0, 3.0, 4.0, [([tuple(s) for s in line],) for line in lines]), (1, 1, 1, 1, 0.0, 0.0, 1.0, 1.0, [])], f"doc_id long, page_no int, block_index int, type int, x0 double, y0 double, x1 double, y1 double, lines {blocks.SPANS}")
    rows = blocks.text_blocks(df, zoom=2.0).collect()
    assert len(rows) == 1 and rows[0].text == "A-b c\nnext" and rows[0].font_size == 12.0 and tuple(rows[0].color) == (1, 2, 3) and rows[0].x1 == 6.0


def test_service(spark, tmp_path):
    now = [datetime(2024, 1, 1)]
    s = Service(spark, f"file://{tmp_path}", clock=lambda: now[0])
    sid = s.create(4)["session_id"]
    with pytest.raises(ConflictError):
        s.ensure(sid, 2)
    assert s.start(sid) == {"status": "running", "priority_pages": [1, 2, 3]} and s.start(sid)["status"] == "running"
    assert {r.page_no: r.queue for r in s.queue(sid).collect()} == {1: "page_high", 2: "page_high", 3: "page_high", 4: "page_normal"}
    assert s.ensure(sid, 2) == []
    now[0] += timedelta(minutes=1)
    assert s.page(sid, 1, "ready", ["w"]) is None and s.page(sid, 2, "ready") is None and s.page(sid, 3, "failed", error="e") is None
    state = s.state(sid)
    assert state["first_readable_ready"] and state["warnings_count"] == 1 and [p["status"] for p in state["pages"]] == ["ready", "ready", "failed", "pending"]
    s.diagnose(sid, [(3, "layout_overflow", "r"), (1, "fallback_events", "f")])
    assert len(s.report(sid)["layout_overflow"]) == 1
    now[0] += timedelta(minutes=1)
    assert s.retry(sid, 3) == "queued" and s.retry(sid, 3) == "skipped" and s.report(sid)["layout_overflow"] == [] and len(s.report(sid)["fallback_events"]) == 1
    now[0] += timedelta(minutes=1)
    assert s.page(sid, 3, "ready") is None and s.page(sid, 4, "ready") == "ready" and s.meta(sid)["overall_status"] == "ready"
    with pytest.raises(NotFoundError):
        s.ensure(sid, 9)
    assert s.sweep() == []
    now[0] += timedelta(hours=2)
    assert s.sweep() == [sid] and s.sweep() == []
    with pytest.raises(NotFoundError):
        s.meta(sid)
    other = s.create(1)["session_id"]
    s.delete(other)
    s.delete(other)
    with pytest.raises(NotFoundError):
        s.state(other)


def test_events_and_memory_of_a_session(spark, tmp_path):
    from datetime import datetime, timedelta

    from leafwork.plans.service import Service

    now = [datetime(2024, 1, 1)]
    s = Service(spark, str(tmp_path / "events"), clock=lambda: now[0])
    sid = s.create(2)["session_id"]
    s.start(sid)
    s.page(sid, 1, "ready")
    s.switched(sid, 2, "a", "b")
    s.page(sid, 2, "failed", error="x")
    kinds = lambda: sorted(r.event for r in s.events(sid).collect())
    assert kinds() == ["page_failed", "page_ready", "progress", "progress", "provider_switched", "session_failed"]
    s.remember(sid, {"f": "one", "g": ""})
    s.remember(sid, {"f": "two"})
    assert [(r.fp, r.translation) for r in s.memory(sid).collect()] == [("f", "two")]
    s.retry(sid, 2)
    assert s.memory(sid).count() == 0
    s.page(sid, 2, "ready")
    now[0] += timedelta(minutes=117)
    assert {"session_ready", "session_expiring"} <= set(kinds())
