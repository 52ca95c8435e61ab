"""Expressions against plain Python over generated texts."""

import json
import random
import re

from pyspark.sql import functions as F

from pagemill.functions import jsonx
from pagemill.functions import text as tx
from pagemill.operators import covers, normalize, ordered, replies
from pagemill.sources import files, providers
from pagemill.streaming import monitors, repetition, retry

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　"
ALPHABET = "ab1 第章，（》\t\n　#\"\\/{}:x"


def texts(n, length=40, alphabet=ALPHABET, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def apply(spark, values, *columns):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", *(c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)))
    return [tuple(r)[1:] for r in rows.orderBy("i").collect()]


def py_cleanup(t):
    """Pairwise rules until nothing changes."""
    t = t.strip()
    cjk = "[㐀-䶿一-鿿]"
    before = None
    while before != t:
        before = t
        for a, b in ((cjk, cjk), (cjk, "[0-9A-Za-z]"), ("[0-9A-Za-z]", cjk)):
            t = re.sub(f"({a})[ \t]+({b})", r"\1\2", t)
    t = re.sub(r"[ \t]+([，。！？；：、）】》])", r"\1", t)
    return re.sub(r"([（【《])[ \t]+", r"\1", t)


def test_cleanup_and_keys(spark):
    values = texts(3000)
    for v, (c, k, n) in zip(values, apply(spark, values, tx.cleanup, tx.heading_key, tx.coverage_length)):
        assert c == py_cleanup(v)
        assert k == re.sub(r"\s+", "", py_cleanup(v)) and n == len(k)


def test_paragraphs(spark):
    values = texts(2000, 30, "ab \n\t")
    for v, (p,) in zip(values, apply(spark, values, tx.paragraphs)):
        want = [re.sub(r"[ \t]*\n[ \t]*", "", b.strip()) for b in re.split(r"\n\s*\n+", v.strip())]
        assert p == [w for w in want if w]


def test_escape_controls(spark):
    def py(t):
        out, inside, esc = [], False, False
        for ch in t:
            if inside and not esc and ch == "\\":
                esc = True
            elif inside and not esc and ch in "\n\r\t":
                ch = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[ch]
            elif inside and not esc and ord(ch) < 32:
                ch = ""
            elif not esc and ch == '"':
                inside = not inside
            else:
                esc = False
                out.append(ch)
                continue
            esc = ch == "\\"
            out.append(ch)
        return "".join(out)

    values = texts(3000, 30, 'a"\n\t\x01{ ')
    for v, (got,) in zip(values, apply(spark, values, jsonx.escape_controls)):
        assert got == py(v), repr(v)


def test_repeated_unit_and_stuck(spark):
    values = texts(1500, 20, "ab") + ["", None] + [u * k for u in ("ab", "/n", "\\n", "x y", "abcabcabz") for k in (1, 40, 300)] + [" " * 70, "x" * 300 + " " * 2000]
    unit = lambda t: bool(t) and any(len(t) % k == 0 and t == t[:k] * (len(t) // k) for k in range(1, 9))
    for v, (u, r) in zip(values, apply(spark, values, tx.is_repeated_unit, repetition.reason)):
        assert u == unit(v)
        assert r == repetition.reason_of(len(v or ""), not (v or "").strip(), (v or "")[-1024:]), repr(v)


def test_parse_tolerance(spark):
    base = json.dumps({"text": "A\nb", "n": [1, {"x": None}]})
    cases = [
        (base, "A\nb"), (f"```json\n{base}\n```", "A\nb"), (f"sure: {base} ok", "A\nb"), ('{""text": "q"}', "q"), ('{"text": "raw\nline"}', "raw\nline"),
        ('{"text": "a", "text": "b"}', "b"), ('{"text": "v", "s": NaN}', "v"), ('{"text": "cut', None), ("", None), (None, None), ("[1]", None),
    ]
    for (v, want), (got,) in zip(cases, apply(spark, [c for c, _ in cases], lambda t: F.get_json_object(jsonx.parse(t), "$.text"))):
        assert got == want, v


def test_string_value_and_objects(spark):
    cases = [('{"text": "a\\nb\\u0041"}', "a\nbA"), ('{"text" : "open', "open"), ('{"n": 1}', ""), ('{"text": 5}', ""), (None, ""), ('x "text":"\\q\\"z"', 'q"z')]
    for (v, want), (got,) in zip(cases, apply(spark, [c for c, _ in cases], lambda t: jsonx.string_value(t, "text"))):
        assert got == want, v
    assert list(jsonx.complete_objects('[{"a":{"b":"}"}},{"c":1')) == ['{"b":"}"}', '{"a":{"b":"}"}}']
    assert list(jsonx.complete_objects(None)) == []
    long = '{"text": "' + "a\\n" * 200_000 + '"}'
    assert len(apply(spark, [long], lambda t: jsonx.string_value(t, "text"))[0][0]) == 400_000


def test_normalised_reply(spark):
    reply = json.dumps({
        "text": "One\n\nTwo", "page_role": "", "blocks": [{"type": "heading", "level": 9, "text": " One "}, 7, {"type": "table", "text": "x"}, {"type": "paragraph", "text": "Two", "continued_from_previous": "yes", "note_markers": [" 1 ", ""]}],
        "notes": ["plain", {"text": "", "marker": "2"}, {"text": "n", "marker": " * ", "type": ""}], "illustrations": [{"bbox": ["0.5", 0.1, 1.7, -1]}, {"bbox": [1, 2, 3]}], "has_illustrations": "no",
    })
    rows = spark.createDataFrame([(1, reply), (2, "{}"), (3, '{"text": "cut'), (4, "nothing"), (5, None), (6, '{"page_role": "blank"}')], "id int, response_text string")
    got = {r.id: r for r in replies.normalised(rows).collect()}
    one = got[1]
    assert [(b.type, b.level, b.text, b.continued_from_previous, b.note_markers) for b in one.blocks] == [("heading", 6, "One", False, []), ("paragraph", 0, "Two", True, ["1"])]
    assert [(n.marker, n.type, n.text) for n in one.notes] == [("", "unknown", "plain"), ("*", "unknown", "n")]
    assert [i.bbox for i in one.illustrations] == [[0.5, 0.1, 1.0, 0.0]] and one.has_illustrations and one.page_role == "unknown"
    assert {k: (r.tier, r.status) for k, r in got.items()} == {1: ("parsed", "ok"), 2: ("parsed", "unusable"), 3: ("backup", "ok"), 4: ("none", "invalid_json"), 5: ("none", "invalid_json"), 6: ("parsed", "ok")}


def test_rebuild_by_hints(spark):
    kind = f"array<{normalize.BLOCK}>"
    rows = spark.createDataFrame([(1, [("heading", 3, "My Head", True, ["2"]), ("quote", 0, "Said so", False, None)], "First\n\nMy  Head\n\n## Mine\n\nSaid so")], f"id int, blocks {kind}, text string")
    got = normalize.with_rebuilt(rows).collect()[0].rebuilt
    assert [(b.type, b.level, b.text) for b in got] == [("paragraph", 0, "First"), ("heading", 3, "My  Head"), ("heading", 2, "Mine"), ("quote", 0, "Said so")]
    assert got[0].continued_from_previous and got[0].note_markers == ["2"]


def test_ordered_operators(spark):
    rng = random.Random(3)
    rows = [(b, p, i, rng.randrange(1, 7), rng.randrange(3)) for b in ("x", "y") for p in rng.sample(range(1, 900), 120) for i in range(rng.randrange(3))]
    df = spark.createDataFrame(rows, "book_id string, page int, block_index int, level int, v int").withColumn("ord", F.col("page") * 100 + F.col("block_index"))
    out = ordered.nearest_smaller(df, "book_id", "ord", "level", 6)
    out = ordered.running_sums(out, "book_id", ["ord"], {"total": F.col("v")})
    out = ordered.with_previous(out, "book_id", ["ord"], F.col("v"), "before")
    for book in "xy":
        got = sorted((r for r in out.collect() if r.book_id == book), key=lambda r: r.ord)
        total, stack, before = 0, [], None
        for r in got:
            while stack and stack[-1][1] >= r.level:
                stack.pop()
            assert r.parent == (stack[-1][0] if stack else None)
            stack.append((r.ord, r.level))
            total += r.v
            assert r.total == total and r.before == before
            before = r.v
    assert ordered.numbered(df.where("v > 9"), "book_id", ["ord"]).count() == 0


def test_covers(spark):
    v = spark.createDataFrame([("a", 1, True, 0.5), ("a", 2, True, 0.9), ("a", 3, True, 0.9), ("a", 4, True, float("nan")), ("a", 9, True, 1.0), ("b", 1, False, 1.0), ("c", 2, True, -1.0)], "book_id string, page int, is_cover boolean, score double")
    assert {r.book_id: r.cover_page for r in covers.best(v).collect()} == {"a": 2, "b": 1, "c": 1}
    replies_ = ['{"is_cover": "yes", "score": 0.3}', '{"is_cover": true}', '{"is_cover": false, "cover_quality": 0.2}', "broken"]
    got = [tuple(x[0]) for x in apply(spark, replies_, covers.verdict)]
    assert got == [(True, 0.3), (True, 1.0), (False, 0.2), (False, 0.0)]
    assert [x[0] for x in apply(spark, ['{"cover_page": 9}', "{}", '{"cover_page": 0}'], lambda t: covers.chosen_page(t, 5))] == [5, 1, 1]


def test_streams(spark):
    lines = [("r", i, x) for i, x in enumerate(['data: {"choices":[{"delta":{"content":"He"}}]}', "", "event: x", "data: broken", 'data: {"choices":[{"delta":{"content":"y"},"finish_reason":"stop"}],"usage":{"t":3}}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"no"}}]}'])]
    df = spark.createDataFrame(lines, "k string, seq int, line string")
    r = monitors.replies(monitors.decode_events(df, ["k"]), ["k"]).collect()[0]
    assert (r.text, r.finish_reason, r.usage) == ("Hey", "stop", {"t": 3})


def test_retry_steps():
    E = retry.Event
    s = retry.State()
    s = retry.step(s, E("invalid_json", "r", "bad"))
    assert (s.attempt, s.previous_invalid, s.outcome) == (2, "r", "")
    assert retry.step(s, E("invalid_json", "r", backup_ok=True)).outcome == "backup"
    assert retry.step(s, E("invalid_json", "r", backup_ok=True, finish_reason="length")).outcome == ""
    t = s
    for _ in range(2):
        t = retry.step(t, E("repetition"))
    assert (t.jitter, t.exclusive, t.temperature) == (2, True, 0.0)
    t = retry.step(t, E("repetition"))
    assert t.outcome == "asked" and t.temperature == 0.1
    assert retry.step(s, E("fatal_vision", message="m")).outcome == "raised" and retry.step(s, E("ok")).outcome == "accepted"
    assert retry.step(retry.State(), E("other"), code=retry.CONTENTS_LATE).outcome == "asked"


def test_files(spark):
    import zlib

    gap = b" " * 3000  # a stream's header is looked for in the 2048 bytes before it
    raw = b"BT (Hello there) Tj ET BT <48656c6c6f20> Tj ET"
    pdf = b"<</Filter/FlateDecode>> stream\n" + zlib.compress(raw) + b"\nendstream" + gap + b"<</Subtype/Image>> stream\n/Im0 Do\nendstream" + gap + b"<</FlateDecode>> stream\nbroken\nendstream"
    got = files.stream_counts(pdf)
    assert (got["streams_scanned"], got["streams_decompressed"], got["image_streams"], got["image_draw_ops"], got["text_objects"], got["text_show_ops"]) == (3, 1, 1, 1, 2, 2)
    df = spark.createDataFrame([("a", bytearray(pdf)), ("b", None)], "path string, content binary")
    assert files.text_layer(df).where("has_text_layer").count() == 0
    assert [x[0] for x in apply(spark, ["Title: x\nPages:   12\n", "none"], files.page_count)] == [12, None]
    assert providers.base_url(" http://h:1/ ") == "http://h:1/v1" == providers.base_url("http://h:1/v1/")


def test_cache_and_package(spark, tmp_path):
    import zipfile

    from pagemill.sinks import cache, epub

    rows = spark.createDataFrame([("b", 1, "old"), ("b", 2, "two")], "book_id string, page int, text string")
    cache.append(rows, str(tmp_path / "c"), 0)
    cache.append(spark.createDataFrame([("b", 1, "new")], rows.schema), str(tmp_path / "c"), 1)
    cache.append(spark.createDataFrame([("b", 1, "new")], rows.schema), str(tmp_path / "c"), 1)
    assert sorted((r.page, r.text) for r in cache.load(spark, str(tmp_path / "c")).collect()) == [(1, "new"), (2, "two")]
    pack = spark.createDataFrame([("b", "OEBPS/x", "1"), ("b", "mimetype", "application/epub+zip"), ("c", "mimetype", "m")], "book_id string, path string, content string")
    out = {r.book_id: r for r in epub.write(pack, str(tmp_path)).collect()}
    with zipfile.ZipFile(out["b"].path) as z:
        assert z.namelist() == ["mimetype", "OEBPS/x"] and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert out["c"].files == 1


def test_parsed_notes_and_variants(spark):
    cases = [("12 text", ("12", "text")), ("³⁴ a b", ("34", "a b")), ("⑩x", ("10", "x")), ("plain", ("", "plain")), ("", ("", "")), (None, ("", "")), (" 7", ("7", ""))]
    for (v, want), (got, forms) in zip(cases, apply(spark, [c for c, _ in cases], tx.parsed_note, tx.marker_variants)):
        assert (got.marker, got.text, got.type) == (*want, "footnote"), v
    assert apply(spark, ["3"], tx.marker_variants)[0][0] == ["³", "③", "[3]", "〔3〕", "［3］", "3"]


def test_navigation_markup(spark):
    from pagemill.sinks import epub

    rng = random.Random(4)
    rows = [("b", p, 0, f"t{p}", rng.randrange(1, 7), "#") for p in rng.sample(range(1, 900), 200)] + [("c", 1, 0, "only", 3, "#")]
    df = spark.createDataFrame(rows, "book_id string, page int, block_index int, text string, level int, href string")
    want, stack = [], []
    for r in sorted(x for x in rows if x[0] == "b"):
        while stack and stack[-1] >= r[4]:
            stack.pop()
        want.append((r[1], len(stack)))
        stack.append(r[4])
    got = epub.navigation_items(df).where("book_id = 'b'").orderBy("ord").collect()
    assert [(r.page, r.depth) for r in got] == want
    html = {r.book_id: r.content for r in epub.navigation_file(df).collect()}
    for text in html.values():
        assert text.count("<ol>") == text.count("</ol>") and text.count("<li>") == text.count("</li>")
        import xml.dom.minidom

        xml.dom.minidom.parseString(text)


def test_package_is_whole(spark, small, tmp_path):
    """XML parses, every link, anchor and manifest item has its file, and every note text of the tables stands in a book."""
    import html
    import posixpath
    import xml.dom.minidom
    import zipfile

    from pagemill.operators import toc
    from pagemill.operators.pages import unique_pages
    from pagemill.plans import reply_queries
    from pagemill.runtime import table
    from pagemill.sinks import epub

    books, pages = table(spark, small, "books"), unique_pages(table(spark, small, "page_results"))
    plan = toc.rule_plan(toc.filtered(toc.candidates(pages)))
    covers = pages.groupBy("book_id").agg(F.lit(b"jpeg").alias("data"))
    rows = epub.package(books, pages, plan, reply_queries._recorded_images(pages), covers).collect()
    files = {(r.book_id, r.path): r for r in rows}
    assert len(files) == len(rows) and {b for b, _ in files} == {r.book_id for r in pages.select("book_id").distinct().collect()}
    anchors = {k: set(re.findall(r'id="([^"]*)"', r.content)) for k, r in files.items() if r.content}
    for (book, path), r in files.items():
        if not path.endswith((".xhtml", ".opf", ".xml", ".ncx")):
            continue
        xml.dom.minidom.parseString(r.content)
        for link in re.findall(r'(?:href|src)="([^"]*)"', r.content):
            file, _, anchor = html.unescape(link).partition("#")
            target = posixpath.normpath(posixpath.join(posixpath.dirname(path), file)) if file else path
            assert (book, target) in files and (not anchor or anchor in anchors[book, target]), (path, link)
        if path.endswith(".opf"):
            listed = {"OEBPS/" + x for x in re.findall(r'<item [^>]*href="([^"]*)"', r.content)}
            assert listed == {p for b, p in files if b == book and p not in ("mimetype", "META-INF/container.xml", path)}
            assert "<dc:language>" in r.content and "dcterms:modified" in r.content and r.content.index('idref="cover-page"') < r.content.index('idref="body1"')
    body = {}
    for (book, path), r in files.items():
        if path.startswith("OEBPS/text/body"):
            body[book] = body.get(book, "") + r.content
    n = 0
    for r in pages.select("book_id", F.explode("notes").alias("n")).collect():
        if (r.n.text or "").strip():
            n += 1
            assert f"<p>{html.escape(r.n.text.strip())}</p></aside>" in body[r.book_id]
    assert n > 50 and all(c.count('class="noteref"') >= c.count("<aside") for c in body.values())
    done = epub.write(spark.createDataFrame(rows, "book_id string, path string, content string, data binary"), "file://" + str(tmp_path)).collect()
    assert sum(w.files for w in done) == len(rows)
    with zipfile.ZipFile(done[0].path) as z:
        assert z.testzip() is None and z.namelist()[0] == "mimetype"
    none = epub.package(books.limit(0), pages.limit(0), plan.limit(0), reply_queries._recorded_images(pages.limit(0)), covers.limit(0))
    assert none.count() == 0


def test_package_keeps_content(spark, small):
    """Note texts, references, captions, heading levels and quotes stand in the body of a package."""
    import xml.dom.minidom

    from pagemill.operators.pages import unique_pages
    from pagemill.runtime import table
    from pagemill.sinks import epub

    schema = unique_pages(table(spark, small, "page_results")).schema
    block = lambda kind, level, text, *marks: {"type": kind, "level": level, "text": text, "continued_from_previous": False, "note_markers": list(marks)}
    page = {f.name: None if f.nullable else False for f in schema} | {
        "result_id": 1, "book_id": "b", "page": 1, "text": "x", "page_role": "body", "page_continues_previous": False,
        "illustrations": [{"bbox": [0.0, 0.0, 1.0, 1.0], "caption": "A <map>", "insert_after": "Said"}, {"bbox": None, "caption": "No box", "insert_after": ""}],
        "blocks": [block("heading", 2, "Part"), block("paragraph", 0, "Said a [a] man 1 & [1] more.", "a", "1"), block("quote", 0, "Verse"), block("paragraph", 0, "End")],
        "notes": [{"marker": "a", "type": "footnote", "text": "First & note", "anchor": ""}, {"marker": "1", "type": "endnote", "text": "Second", "anchor": ""}, {"marker": "z", "type": None, "text": "Third", "anchor": "nowhere"}],
    }
    later = page | {"result_id": 2, "page": 2, "page_continues_previous": True, "illustrations": [], "blocks": [block("paragraph", 0, " of it"), block("paragraph", 0, "New")], "notes": [{"marker": "9", "type": "footnote", "text": "Back", "anchor": "Verse"}]}
    later["blocks"][1]["note_markers"] = ["9"]
    later["blocks"].pop(1)
    later["blocks"].append(block("heading", 1, "", "9"))
    df = spark.createDataFrame([tuple(p[f.name] for f in schema) for p in (page, later)], schema)
    images = epub.figure_requests(df).withColumn("data", F.lit(b"x"))
    assert [(r.result_id, r.figure_index) for r in images.collect()] == [(1, 0)]
    (row,) = epub.body_files(df, images=images).collect()
    xml.dom.minidom.parseString(row.content)
    for want in (
        '<h3 id="heading-0001" class="section-heading">Part</h3>', '<p id="block-0003" class="quote">Verse</p>', '<img src="../images/illustration-0001.jpg" alt="A &lt;map&gt;"/><figcaption>A &lt;map&gt;</figcaption></figure>',
        '<aside epub:type="footnote" class="note footnote" id="fn-0001"><p>First &amp; note</p></aside>', '<aside epub:type="footnote" class="note endnote" id="fn-0002"><p>Second</p></aside>',
        '<p id="block-0002">Said a <a epub:type="noteref" class="noteref" id="fnref-0001" href="#fn-0001" data-label="a"', 'man 1 &amp; <a epub:type="noteref" class="noteref" id="fnref-0002"',
        '<p id="block-0004">End<a epub:type="noteref" class="noteref" id="fnref-0003"', 'class="note unknown" id="fn-0003"><p>Third</p></aside>',
        '<p id="block-0003" class="quote">Verse</p>\n<aside epub:type="footnote" class="note footnote" id="fn-0004"><p>Back</p></aside>',
    ):
        assert want in row.content, (want, row.content)
    assert "No box" not in row.content and "<figure" not in epub.body_files(df).collect()[0].content
    small_files = epub.body_files(df, size=2).orderBy("path").collect()
    assert len(small_files) == 2 and 'id="block-0005"' in small_files[1].content and 'id="fn-0004"' in small_files[1].content


def test_continued_paragraphs_join(spark, small):
    """A paragraph over a page end is one, unless a heading, note or figure stands between."""
    from pagemill.operators.pages import unique_pages
    from pagemill.runtime import table
    from pagemill.sinks import epub

    schema = unique_pages(table(spark, small, "page_results")).schema
    block = lambda kind, text: {"type": kind, "level": 1, "text": text, "continued_from_previous": False, "note_markers": []}
    empty = {f.name: None if f.nullable else False for f in schema} | {"book_id": "b", "page_role": "body", "page_continues_previous": True, "illustrations": [], "notes": []}
    pages = [empty | {"result_id": i, "page": i, "blocks": [block(k, t) for k, t in blocks]} for i, blocks in enumerate(([("paragraph", "one")], [("paragraph", " two"), ("heading", "H")], [("paragraph", "three")]), 1)]
    (row,) = epub.body_files(spark.createDataFrame([tuple(p[f.name] for f in schema) for p in pages], schema)).collect()
    assert '<p id="block-0001">onetwo</p>' in row.content and '<p id="block-0004">three</p>' in row.content


def test_thresholds_catch_up(spark):
    from pagemill.streaming import monitors

    rng = random.Random(9)
    rows = [("a", i, n) for i, n in enumerate((9000, 1, 1))] + [("b", i, rng.choice([0, 1, 700, 1999, 2000, 5000, None])) for i in range(400)]
    want, state = set(), {}
    for key, i, n in rows:
        total, mark = state.get(key, (0, 2000))
        total += n or 0
        if total >= mark:
            want.add((key, i, total))
            mark += 2000
        state[key] = (total, mark)
    df = spark.createDataFrame(rows, "k string, seq long, n int")
    assert {tuple(r) for r in monitors.thresholds(df, "k", "seq", "n").collect()} == want and len([w for w in want if w[0] == "a"]) == 3


def test_raw_vision_failures_are_fatal(spark):
    from pagemill.operators import replies

    rows = [("ValueError in Qwen3VLProcessor", ""), ("Failed to apply the transform to images", None), ("LLM vision preprocessing failed: HTTP 500", "stop"), ("Failed to apply patch", ""), (None, "LENGTH"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "error string, finish_reason string").select(replies.error_class()).collect()]
    assert got == ["fatal_vision"] * 3 + ["other", "truncated", None]


def test_stages_are_deleted(spark):
    from pathlib import Path

    from pagemill import runtime

    folder = Path(runtime.shared_dir(spark).removeprefix("file:").replace("//", "/", 1))
    before = set(folder.iterdir())
    with runtime.stages(spark):
        assert runtime.written(spark.range(5)).count() == 5 and set(folder.iterdir()) != before
    assert set(folder.iterdir()) == before
    runtime.written(spark.range(5))
    assert runtime.drop_stages(spark) >= 1 and not any(p.name.startswith("stage-") for p in folder.iterdir())


def test_hot_keys_meet_their_row_in_parts(spark, monkeypatch):
    from pagemill import runtime

    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 7)) AS k")
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    whole = sorted(map(tuple, runtime.join_key_row(rows, small, "k", ["id"], how="left").select("id", "v").collect()))
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, runtime.join_key_row(rows, small, "k", ["id"], how="left").select("id", "v").collect())) == whole and len(whole) == 1000


def test_plan_rules_headings(spark):
    """With a plan exactly the planned headings stay, at their planned level, also one that repeats the title."""
    from pagemill.operators import body

    block = "array<struct<type string, level int, text string, continued_from_previous boolean, note_markers array<string>>>"
    h = lambda t: ("heading", 1, t, False, [])
    rows = [(1, "b", 1, "T", True, [h("T"), h("U"), ("paragraph", 0, "x", False, [])], []), (2, "c", 1, "T", True, [h("T"), h("U")], [])]
    df = spark.createDataFrame(rows, f"result_id long, book_id string, page int, title string, page_continues_previous boolean, blocks {block}, illustrations array<struct<caption string>>").withColumn("text", F.lit(""))
    plan = spark.createDataFrame([("b", 1, 0, 2, 0), ("b", 1, 0, 3, 1)], "book_id string, page int, block_index int, level int, ord int")
    kept = lambda p: {r.book_id: [(b.text, b.level) for b in r.kept] for r in body.kept_blocks(df, plan=p).collect()}
    assert kept(plan) == {"b": [("T", 3), ("x", 0)], "c": [("U", 1)]} and kept(None) == {"b": [("U", 1), ("x", 0)], "c": [("U", 1)]}
