"""Drivers, providers against a stub endpoint, renderer, settings and saved state on small cases."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagemill import settings
from pagemill.functions import jsonx
from pagemill.operators import drivers, normalize, resume
from pagemill.sources import files, providers, renderer
from pagemill.streaming import monitors


@pytest.fixture(scope="module")
def endpoint():
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def send(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def do_GET(self):
            self.send(200, json.dumps({"data": [{"id": "first"}, {"id": "second"}]}))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            content = body["messages"][0]["content"]
            prompt = content if isinstance(content, str) else content[0]["text"]
            if prompt == "bad":
                return self.send(400, "Failed to apply Qwen2VLProcessor on images")
            if prompt == "busy":
                return self.send(503, "try later")
            parts = [" " * 80, "more"] if prompt == "stuck" else ["Hel", "lo ", prompt]
            if body["stream"]:
                lines = ["", ": ping", *("data: " + json.dumps({"choices": [{"delta": {"content": p}}]}) for p in parts)]
                lines += ["data: " + json.dumps({"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"total_tokens": 5}}), "data: [DONE]", "data: no"]
                return self.send(200, "\n".join(lines) + "\n")
            self.send(200, json.dumps({"choices": [{"message": {"content": "".join(parts)}, "finish_reason": "stop"}], "usage": {"total_tokens": 5, "detail": {}}}))

    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


@pytest.mark.parametrize("stream", [False, True])
def test_endpoint(spark, endpoint, stream):
    url, seen = endpoint
    rows = [("b", 1, 1, "page", ["data:image/png;base64,AA=="], 0.9), ("b", 2, 1, "bad", ["x"], None), ("b", 3, 1, "busy", [], 0.0), ("b", 4, 1, "stuck", [], 0.0)]
    df = spark.createDataFrame(rows, "book_id string, page int, attempt int, prompt string, images array<string>, temperature double")
    model = providers.Http(url, stream=stream, parallel=2, longest_side=2000)
    got = {r.page: r for r in model.answer(df).collect()}
    assert got[1].response_text == "Hello page" and got[1].finish_reason == "stop" and got[1].usage == {"total_tokens": 5} and got[1].error is None
    assert got[2].error.startswith("vision preprocessing failed: HTTP 400; longest image side 2000") and "503" in got[3].error and "try later" in got[3].error
    assert (got[4].finish_reason == "repetition") == stream and (not stream or "stuck" in got[4].error)
    body = next(b for b in seen if b["messages"][0]["content"] != "busy" and isinstance(b["messages"][0]["content"], list) and b["messages"][0]["content"][0]["text"] == "page" and b["stream"] == stream)
    assert body["model"] == "first" and body["temperature"] == 0.3 and body["messages"][0]["content"][1]["image_url"]["url"].startswith("data:")
    assert model.exclusive().parallel == 1 and providers.Http(url, model="own").resolved() == "own" and providers.max_tokens(3) == 512
    (down,) = providers.Http("http://127.0.0.1:9").answer(df.limit(1)).collect()
    assert down.response_text is None and "request failed" in down.error


def test_contents_items(spark):
    reply = json.dumps({"items": [{"page": "3", "block_index": 0, "label": " 第 一 ", "level": 9}, {"block_index": 1, "label": "b", "level": 0}, {"page": 1, "label": "no block"}, {"page": 1, "block_index": 2, "label": " "}, {"page": "x", "block_index": 1, "label": "c"}, 5, None]})
    rows = spark.createDataFrame([(reply,), ('{"items": 5}',), ("[]",), (None,)], "r string")
    got = [[(x.page, x.block_index, x.label, x.level) for x in r[0]] for r in rows.select(drivers.contents_items(jsonx.parse(F.col("r")))).collect()]
    assert got == [[(3, 0, "第一", 4), (0, 1, "b", 1)], [], [], []]


def test_pages_in_rounds(spark):
    """Retries, corrections, the model to itself, and the request after a stuck reply."""
    page = json.dumps({"text": "words", "page_role": "body"})
    asked = []

    class Model:
        def __init__(self, alone=False):
            self.alone = alone

        def exclusive(self):
            return Model(True)

        def answer(self, requests, keys):
            rows = requests.collect()
            asked.extend((self.alone, r.page, r.attempt, r.jitter, r.temperature, "last reply" in r.prompt) for r in rows if "attempt" in keys and len(keys) == 3)
            out = [(*(r[k] for k in keys), None if r.page == 2 else page if r.attempt == 4 else "x", "repetition" if r.page == 1 and r.attempt < 4 else "stop", "boom" if r.page == 2 else None, 1.0, None) for r in rows]
            kinds = dict(requests.dtypes)
            return spark.createDataFrame(out, ", ".join([*(f"{k} {kinds[k]}" for k in keys), providers.REPLY]))

    requests = spark.createDataFrame([("b", 1, "i", []), ("b", 2, "i", [])], "book_id string, page int, image_path string, images array<string>")
    results, ends = drivers.read_pages(requests, Model())
    assert [(r.page, r.text, r.tier) for r in results.collect()] == [(1, "words", "parsed")]
    assert sorted((r.page, r.attempts, r.outcome) for r in ends.collect()) == [(1, 4, "accepted"), (2, 4, "asked")]
    own = {a[2]: a for a in asked if a[1] == 1}
    assert [own[k][0] for k in (1, 2, 3, 4)] == [False, True, True, True] and [own[k][3] for k in (1, 2, 3, 4)] == [0, 1, 2, 3] and own[4][4] == 0.1 and not own[2][5]
    assert all(a[5] == (a[2] > 1) for a in asked if a[1] == 2)


def test_whole_job_resumes(spark):
    page = lambda n: json.dumps({"text": f"# Part {n}\n\nwords", "page_role": "body", "blocks": [{"type": "heading", "level": 1, "text": f"Part {n}"}, {"type": "paragraph", "text": "words"}]})
    recorded = spark.createDataFrame([("b", n, 1, page(n), "stop") for n in (1, 2)], "book_id string, page int, attempt int, response_text string, finish_reason string")
    requests = spark.createDataFrame([("b", n, "i", []) for n in (1, 2, 3)], "book_id string, page int, image_path string, images array<string>")
    none = providers.Replay(spark.createDataFrame([], "book_id string, chunk int, attempt int, response_text string"))
    job = drivers.whole_job(requests, providers.Replay(recorded), none)
    assert [(r.page, r.label, r.reason) for r in job["plan"].orderBy("page").collect()] == [(1, "Part 1", "rule"), (2, "Part 2", "rule")]
    assert [r.page for r in job["missing"].collect()] == [3] and [(r.tier, r.attempts) for r in job["chunks"].collect()] == [("fallback", 3)]
    again = drivers.whole_job(requests, providers.Replay(recorded.limit(0)), none, cached=job["results"])
    assert again["results"].count() == 2 and {r.page for r in again["ends"].collect()} == {3}


def test_covers(spark):
    images = spark.createDataFrame([(b, p, "x") for b in ("one", "two", "alone") for p in ((1, 2, 3) if b != "alone" else (1,))], "book_id string, page int, image string")

    class Model:
        def answer(self, requests, keys):
            out = []
            for r in requests.collect():
                if len(keys) == 1:
                    out.append((r.book_id, '{"cover_page": 9}' if r.book_id == "one" else None, None, None if r.book_id == "one" else "Qwen3VLProcessor says no", None, None))
                else:
                    out.append((r.book_id, r.page, json.dumps({"is_cover": r.page > 1, "cover_quality": "0.5"}), None, "timed out" if r.page == 2 and r.book_id == "x" else None, None, None))
            return spark.createDataFrame(out, "book_id string, " + ("page int, " if len(keys) == 2 else "") + providers.REPLY)

    got = {r.book_id: (r.cover_page, r.reason) for r in drivers.choose_covers(images, Model()).collect()}
    assert got["one"][0] == 3 and got["two"][0] == 2 and got["alone"][0] == 1
    assert {r.book_id: r.cover_page for r in drivers.choose_covers(images, Model(), together=False).collect()} == {"one": 2, "two": 2, "alone": 1}


def test_images_are_renumbered(spark, tmp_path):
    for book, names in {"a": ["p10.jpg", "p9.PNG", "Cover.jpg", "p2.jpeg", "x.txt"], "b": ["cover1.png", "z.jpg"]}.items():
        (tmp_path / book).mkdir()
        for n in names:
            (tmp_path / book / n).write_bytes(n.encode())
    docs = spark.createDataFrame([("a", "a.pdf"), ("b", "b.pdf"), ("c", "c.pdf")], "book_id string, path string")
    got = renderer.Folder("file://" + str(tmp_path)).images(spark, docs)
    rows = {(r.book_id, r.page): (r.name, r.file) for r in renderer.numbered_images(got, drop_covers=True).collect()}
    assert rows == {("a", 1): ("p2.jpeg", "page_0001.jpg"), ("a", 2): ("p9.PNG", "page_0002.jpg"), ("a", 3): ("p10.jpg", "page_0003.jpg"), ("b", 1): ("z.jpg", "page_0001.jpg")}

    class Nothing:
        def images(self, spark, documents):
            return got.where("book_id = 'a'")

    both = renderer.rendered(spark, docs, Nothing(), renderer.Folder("file://" + str(tmp_path))).groupBy("book_id").count().collect()
    assert {r.book_id: r["count"] for r in both} == {"a": 4, "b": 1}
    many = spark.range(3000).select(F.lit("big").alias("book_id"), F.concat(F.lit("page "), F.col("id").cast("string"), F.lit(".jpg")).alias("name"))
    assert renderer.numbered_images(many).where(F.col("name") != F.concat(F.lit("page "), (F.col("page") - 1).cast("string"), F.lit(".jpg"))).count() == 0
    counts = spark.createDataFrame([("Pages: 7\n", 3), ("none", 3), (None, None)], "r string, n int").select(renderer.page_count(F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in counts] == [7, 3, None]


def test_settings():
    s = settings.overlaid({"parallel_pages": 99, "toc_chunk_size": 1, "keep_recovery_cache": False, "other": 1, "model": None})
    assert (s.parallel_pages, s.toc_chunk_size, s.keep_recovery_cache, s.prefs_version, s.model) == (8, 10, True, 2, "")
    assert not settings.overlaid({"keep_recovery_cache": False, "prefs_version": 2}).keep_recovery_cache and settings.overlaid() == settings.Settings()


def test_saved_state(spark):
    caches = spark.createDataFrame([("a", [(1, "old1"), (2, "old2")]), ("b", [(1, "old")]), ("c", None)], "book_id string, results array<struct<page:int,image_path:string>>")
    images = spark.createDataFrame([("a", 1, "new1"), ("a", 2, "new2"), ("b", 1, "n"), ("b", 2, "n2")], "book_id string, page int, path string")
    got = {(r.book_id, r.page): (r.image_path, r.status) for r in resume.loaded_state(caches, images).collect()}
    assert got == {("a", 1): ("new1", "ok"), ("a", 2): ("new2", "ok"), ("b", None): (None, "count_mismatch")}
    assert {(r.book_id, r.page) for r in resume.loaded_state(caches, images, True).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    old = spark.createDataFrame([("x/1", "o"), ("y/2", "o")], "path string, content string")
    assert [r.path for r in resume.to_migrate(old, old.where("path = 'x/1'")).collect()] == ["y/2"]


def test_streams_of_documents():
    import zlib

    text = b"BT (one \\) two) Tj [(a) 3 (b)] TJ <48656C6C6F20776F> Tj ET /Im1 Do (not shown) (n(es)ted) Tj"
    n = files.operators(text)
    assert n == (1, 4, len(b"(one \\) two) Tj") - 4 + (len(b"<48656C6C6F20776F> Tj") - 4) // 2, 1)
    doc = b"1 0 obj <</Filter /FlateDecode>> stream\r\n" + zlib.compress(text) + b"\r\nendstream <</Subtype /Image /FlateDecode>> stream\nbroken\nendstream"
    got = files.stream_counts(doc)
    assert (got["text_objects"], got["text_show_ops"], got["image_draw_ops"], got["image_streams"], got["streams_scanned"], got["streams_decompressed"]) == (1, 4, 1, 1, 2, 1)
    assert files.stream_counts(b"stream\n(" + b"(" * 50_000)["text_bytes"] == 0 and files.stream_counts(b"")["streams_scanned"] == 0
    assert files.stream_counts(b"".join(b"stream\nBT\nendstream\n" for _ in range(9)), 3)["streams_scanned"] == 3


def test_read_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"stream\nBT (Hello there) Tj ET\nendstream")
    (tmp_path / "b.pdf").write_bytes(b"x" * 50)
    rows = {r.path[-5:]: r for r in files.read_binary(spark, "file://" + str(tmp_path), "*.pdf", 40).collect()}
    assert rows["a.pdf"].truncated is False and rows["b.pdf"].truncated is True and len(rows["b.pdf"].content) == 40
    layers = files.text_layer(files.read_binary(spark, "file://" + str(tmp_path), "*.pdf")).collect()
    assert {r.path[-5:]: (r.text_show_ops, r.reason) for r in layers} == {"a.pdf": (2, "none"), "b.pdf": (0, "none")}


def test_progress(spark):
    results = spark.createDataFrame([("b", 1, "abc", 1.0), ("b", 2, None, None)], "book_id string, page int, text string, seconds double")
    requests = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3), ("c", 1)], "book_id string, page int")
    got = {r.book_id: (r.pages, r.done, r.chars, r.seconds) for r in monitors.page_progress(results, requests).collect()}
    assert got == {"b": (3, 2, 3, 1.0), "c": (1, 0, 0, 0.0)}
    listener = monitors.Progress()
    spark.streams.addListener(listener)
    spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("noop").trigger(once=True).start().awaitTermination(60)
    spark.streams.removeListener(listener)
    assert listener.batches is not None


def test_cancelled_jobs_end(spark):
    import time

    from pagemill import runtime

    failed = []

    def slow():
        with runtime.cancellable(spark, "slow"):
            try:
                spark.range(4, numPartitions=4).selectExpr("sum(if(id >= 0, length(reverse(repeat('x', 90000000))), 0))").mapInPandas(lambda it: (time.sleep(60) or x for x in it), "x long").collect()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=slow)
    t.start()
    time.sleep(4)
    runtime.cancel(spark, "slow")
    t.join(40)
    assert not t.is_alive() and failed


def test_patches_in_turn(spark):
    block = "array<struct<type:string,level:int,text:string,continued_from_previous:boolean,note_markers:array<string>>>"
    rows = [("T", [("heading", 1, "U", False, []), ("paragraph", 0, "a", False, []), ("paragraph", 0, "b", False, [])], [])]
    df = spark.createDataFrame(rows, f"title string, blocks {block}, notes array<{normalize.NOTE}>")
    patch = lambda t, d: f"named_struct('set_title', {t}, 'set_page_continues_previous', cast(null as boolean), 'delete_block_indices', array({d}), 'set_block_continued_from_previous', null, 'replace_notes', null, 'add_notes', null)"
    patches = F.expr(f"array({patch('cast(null as string)', 1)}, {patch(repr('U'), 0)}, {patch('null', 1)})").cast(f"array<{normalize.PATCH}>")
    r = df.select(normalize.patched_page(F.col("blocks"), F.col("notes"), F.col("title"), F.lit(False), patches).alias("r")).collect()[0].r
    assert r.title == "U" and [b.text for b in r.blocks] == ["U"]  # the heading is the title by then, and stays


def test_streams_as_a_table(spark):
    import zlib

    content = b"<</Length 9>> stream\nBT (Hello) Tj ET\nendstream <</Filter/FlateDecode>> stream\n" + zlib.compress(b"/I Do /J Do") + b"\nendstream"
    df = spark.createDataFrame([("d", bytearray(content)), ("e", None)], "id string, content binary")
    got = [tuple(r) for r in df.lateralJoin(files.PdfStreams(F.col("content").outer())).orderBy("id", "ord").select("id", "ord", "inflated", "text_show_ops", "text_bytes", "image_draw_ops").collect()]
    assert got == [("d", 0, False, 1, 6, 0), ("d", 1, True, 0, 0, 2)]


def test_images(spark):
    """Recorded images answer; without an imaging library figures are not cut and all else stays as it is."""
    from pagemill.sources import images
    from pagemill.streaming import retry

    requests = spark.createDataFrame([(1, "b", 1, 0, [0.0, 0.0, 0.5, 0.5]), (2, "b", 2, 0, [0.0, 0.0, 1.0, 1.0])], "result_id long, book_id string, page int, figure_index int, bbox array<double>")
    pages = spark.createDataFrame([("b", 1, bytearray(b"no image")), ("b", 2, None)], "book_id string, page int, data binary")
    recorded = images.Recorded(spark.createDataFrame([(1, 0, bytearray(b"x")), (9, 0, bytearray(b"y"))], "result_id long, figure_index int, data binary"))
    assert [(r.result_id, bytes(r.data)) for r in recorded.figures(requests, pages).collect()] == [(1, b"x")]
    assert images.Library().figures(requests, pages).count() == 0
    assert {bytes(r.data) for r in images.Library().covers(pages.where("data IS NOT NULL")).collect()} == {b"no image"} and recorded.covers(pages).count() == 2
    urls = images.data_urls(pages.withColumn("suffix", F.lit(".png"))).orderBy("page").collect()
    assert urls[0].url == "data:image/png;base64,bm8gaW1hZ2U=" and urls[1].url is None
    moved = images.shifted(pages.withColumn("box", retry.jitter_box(F.lit("p"), F.col("page"), F.lit(1)))).orderBy("page").collect()
    assert bytes(moved[0].data) == b"no image" and moved[1].data is None
    assert images.rectangle([0.1, 0.2, 0.1, 2.0], 100, 50) == (10, 10, 11, 50)
