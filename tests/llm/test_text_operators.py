"""The text operators on small cases, against brute force, and on empty, null and awkward tables."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import boilerplate, canonical, leaks, lexicon, mail, packing, pagetext, pii, truncation
from pagemill.llm import queries as llm_queries
from pagemill.runtime import table

# ---- canonical form ---------------------------------------------------------------------------------------------------


def test_canonical():
    same = [("Ａｂｃ", "Abc"), ("él", "él"), ("a​b﻿", "ab"), ("a b ", "a b"), ("non‑stop", "non-stop"), ("Тhе ѕermon", "The sermon"), ("１２", "12"), ("＊⁠", "*"), ("so­ft", "soft")]
    for a, b in same:
        assert canonical.canonical(a) == canonical.canonical(b), a
    for a, b in (("é", "e"), ("A", "a"), ("1", "¹"), ("†", "‡"), ("a  b", "ab"), ("ﬁ", "x")):
        assert canonical.canonical(a) != canonical.canonical(b), a
    assert canonical.canonical(None) is None and canonical.canonical("​ ") == ""
    assert canonical.canonical("Ｓtraße ①", compat=True, fold=True) == "strasse 1"
    for cp in range(0x250):
        once = canonical.canonical(chr(cp))
        assert canonical.canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), rng.choice(["1", "１", "1 ", None]), rng.choice(["Note a", "Nоte a", "Note a", "note a", "Note  a", ""])) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:20], "note_id long, book_id string, marker string, text string").withColumn("marker_form", F.lit("clash"))
    form = lambda r: (r[1], canonical.canonical(r[2] or ""), canonical.canonical(r[3] or ""))
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if form(a) == form(b) and (a[2] or "", a[3] or "") != (b[2] or "", b[3] or "")}
    got = [tuple(r) for r in canonical.look_alike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    links = {}
    for a, b in want:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    classes = canonical.look_alike_classes(df).collect()
    assert {r.note_id: r.n_links for r in classes} == {k: len(v) for k, v in links.items()} and len(classes) == len(links)
    of = {r.note_id: r.class_id for r in classes}
    assert all(of[a] == of[b] for a, b in want) and all(form(rows[k]) == form(rows[c]) and c <= k for k, c in of.items())


def test_large_groups_are_cut(spark, monkeypatch):
    """A stock note with many spellings is paired in shards; the pairs stay the same."""
    rows = [(i, "x", "1", "Ibid" + "\u200b" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "note_id long, book_id string, marker string, text string")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 7 != b % 7}
    monkeypatch.setattr(canonical, "PAIR_SHARD", 9)
    assert {tuple(r) for r in canonical.look_alike_pairs(df).collect()} == want


def test_equal_looks_lie_in_one_block():
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(0x20, 0x500), *range(0x1E00, 0x2100), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF60))]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(5))
        look = canonical.canonical(text)
        assert canonical.canonical(look) == look and canonical.canonical(look, True, True) == canonical.canonical(canonical.canonical(look), True, True)


# ---- boilerplate ------------------------------------------------------------------------------------------------------

PAGES = "result_id long, book_id string, site string, page int, title string, blocks array<struct<type:string,level:int,text:string,continued_from_previous:boolean,note_markers:array<string>>>"


def block(text):
    return ("paragraph", 0, text, False, [])


def test_boilerplate(spark):
    rows = [(i, f"b{i % 4}", "s", i, "Chapter", [block(f"own {i}\nText"), block("Share  THIS page\nAll rights")] if i % 3 == 0 else [block(f"only {i}"), block(None)]) for i in range(60)]
    rows += [(900, None, None, None, None, None), (901, "b1", "s", 1000, None, [])] + rows[:10]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.line: r for r in boilerplate.blocks(df).where("site = 's'").collect()}
    assert set(got) == {"share this page", "all rights", "chapter", "text"}
    assert got["share this page"].block == got["all rights"].block and got["chapter"].n_pages == 60
    clean = {r.result_id: r for r in boilerplate.cleaned(df, boilerplate.blocks(df).where("line <> 'text'")).collect()}
    assert len(clean) == 62 and [b.text for b in clean[0].blocks] == ["own 0\nText"] and clean[0].title is None and clean[0].removed == 3
    assert [b.text for b in clean[1].blocks] == ["only 1", None] and clean[900].blocks is None


# ---- page text --------------------------------------------------------------------------------------------------------


def brute_distance(a, b):
    """Edits where every known misreading counts one."""
    best = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            now = best.get((i, j))
            if now is None:
                continue
            steps = [(1, 1, 0 if a[i : i + 1] == b[j : j + 1] else 1), (1, 0, 1), (0, 1, 1)]
            steps += [(len(x), len(y), 1) for x, y in lexicon.CHEAP if len(x) + len(y) == 3 and a.startswith(x, i) and b.startswith(y, j)]
            for di, dj, c in steps:
                if i + di <= len(a) and j + dj <= len(b):
                    best[i + di, j + dj] = min(best.get((i + di, j + dj), 99), now + c)
    return best[len(a), len(b)]


def test_automaton_is_complete():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdnrimu") for _ in range(rng.randrange(1, 7))) for _ in range(250)})
    trie = lexicon.Trie([(w, 1 + k % 7) for k, w in enumerate(words)])
    for _ in range(60):
        q = "".join(rng.choice("abclrii1") for _ in range(rng.randrange(1, 7)))
        for limit in (1, 2, 3):
            assert sorted(w for w, _, _ in trie.within(q, limit)) == [w for w in words if brute_distance(w, q) <= limit], (q, limit)


@pytest.mark.parametrize("top", [5, 12])
def test_paid_edits_lose_nothing(top):
    """Following only edits that a word below can pay for finds every candidate with a positive score."""
    import math

    rng = random.Random(8)
    letters = "abcdnrimuo0l1"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(300)} | {"northern", "tavern", "chronicle"})
    counts = {w: int(10 ** rng.uniform(0.5, top)) for w in words}
    trie = lexicon.Trie(list(counts.items()))
    asked = ["northem", "tavcm", "chronide", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(40))]
    for w in words[:40]:  # words with one or two known misreadings
        for a, b in rng.sample(sorted(lexicon.CHEAP), 4):
            asked.append(w.replace(a, b, 1))
    for q in asked:
        n = rng.choice([1, 2, 50])
        gain = {w: math.log(c) - lexicon.channel_cost(w, q) - math.log(n) for w, c in counts.items()}
        want = {w for w in words if w != q and brute_distance(w, q) <= lexicon.edit_limit(q) and gain[w] > 0}
        got = {w for w, _ in lexicon.suggestions(trie, q, n)}
        assert want <= got and all(gain[w] > 0 for w in got), (q, n)


def test_candidates_do_not_depend_on_blocks(spark):
    counts = spark.createDataFrame([("clog", 100), ("elog", 90_000), ("c1og", 1), ("snow", 800), ("sn0w", 2), ("slow", 900), ("s1ow", 1), ("bi" * 30, 900), ("b1" + "bi" * 29, 1)], "word string, n long")
    one = sorted(map(tuple, lexicon.corrections(counts).collect()))
    assert one == sorted(map(tuple, lexicon.corrections(counts, block=2, shard=1).collect())) == sorted(map(tuple, lexicon.corrections(counts, block=1, shard=3).collect()))
    got = {}
    for word, _, fix, score, rank in one:
        got.setdefault(word, []).append((rank, fix))
    assert [f for _, f in sorted(got["c1og"])] == ["elog", "clog"] and [f for _, f in got["b1" + "bi" * 29]] == ["bi" * 30] and got["sn0w"][0] == (0, "snow")


def test_learned_edits_lose_nothing():
    """With learned costs, too, the search finds every candidate with a positive score."""
    import math

    rng = random.Random(9)
    letters = "abcdnrimuxy"
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    counts = {w: int(10 ** rng.uniform(0.5, 7)) for w in words}
    trie = lexicon.Trie(list(counts.items()))
    for costs in (lexicon.Costs({("x", "y"): 4.0, ("a", "x"): 9.0}, {"n": 5.0}, {"y": 6.0}, 12.0), lexicon.Costs({("m", "b"): 3.0}, {}, {}, math.inf), lexicon.Costs(other=7.0)):
        for q in rng.sample(words, 60) + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(40)]:
            n = rng.choice([1, 2, 50])
            gain = {w: math.log(c) - lexicon.channel_cost(w, q, costs) - math.log(n) for w, c in counts.items()}
            want = {w for w in words if w != q and brute_distance(w, q) <= lexicon.edit_limit(q) and gain[w] > 0}
            got = {w for w, _ in lexicon.suggestions(trie, q, n, costs)}
            assert want <= got and all(gain[w] > 0 for w in got), (q, n)


STOCK = "mother father other whether weather neither nothing another together brother farther leather feather gather either rather mathematics method panther anthem garden candle evening kitchen lantern winter silver window".split()


def misread_corpus(edits, rate, n=2000):
    """Counts of a vocabulary in which ``edits`` take place at every site at a rate, and of a few genuine rare neighbours."""
    counts = {w: n + 10 * k for k, w in enumerate(STOCK)} | {"gander": 3, "winder": 5, "mitten": 9, "farmer": 4}
    want = {}
    for w in STOCK:
        for a, b in edits:
            for i in range(1, len(w) - 1):
                if w.startswith(a, i) and (form := w[:i] + b + w[i + len(a) :]) not in counts:
                    counts[form], want[form] = max(1, int(counts[w] * rate)), w
    return counts, want


@pytest.mark.parametrize("edits, rate", [([("h", "b")], 1 / 200), ([("h", "b")], 1 / 1500), ([("h", "k"), ("t", "")], 1 / 300), ([("", "j")], 1 / 200)])
def test_edits_that_no_list_knows(spark, edits, rate):
    """A confusion that the corpus shows at many words is followed though no list names it; genuine rare words stay."""
    counts, want = misread_corpus(edits, rate)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.fix for r in lexicon.corrections(df).where("rank = 0").collect()}
    assert got == want and len(want) >= 15
    assert got == {r.word: r.fix for r in lexicon.corrections(df, block=3, shard=2).where("rank = 0").collect()}


def test_seldom_edits_stay(spark):
    """Where few words show an edit it is no confusion, and without any the cost is the set one."""
    counts, _ = misread_corpus([], 0)
    odd = counts | {"motber": 2, "fatber": 1, "gardem": 1}
    df = spark.createDataFrame(list(odd.items()), "word string, n long")
    assert lexicon.corrections(df).isEmpty()
    assert lexicon.learned_costs(df, lexicon.vocabulary(df)) == lexicon.UNLEARNED
    hist = [(10, 100, 100 * 1500.0)]
    ones = np.ones(4)
    assert lexicon.edit_rate(1500 * ones, ones, hist) is None
    many = np.ones(80)
    assert 0.0019 < lexicon.edit_rate(1500 * many, 3 * many, hist) <= 0.002  # the median share, where most sites show it
    assert lexicon.edit_rate(1500 * np.ones(9), 200 * np.ones(9), hist) < 1e-4  # genuine words at a few sites


def test_words_of_capitals_count(spark):
    pages = spark.createDataFrame([("THE 0LD LAMP\nthe lamp stands",), ("THE OLD LAMP\nan old lamp",), (None,), ("",)], "text string")
    assert {r.word: r.n for r in lexicon.word_counts(pages).collect()} == {"the": 1, "lamp": 2, "stands": 1, "an": 1, "old": 1, "0ld": 1}


def test_corrections_and_context(spark):
    counts = spark.createDataFrame([("daughter", 900), ("daiightcr", 1), ("crooked", 90), ("cooked", 80), ("the", 5000), ("tbe", 2), ("ncver", 1), ("never", 500), ("2o", 4), ("lt", 3), ("it", 900)], "word string, n long")
    got = {r.word: r.fix for r in lexicon.corrections(counts).where("rank = 0").collect()}
    assert got == {"daiightcr": "daughter", "ncver": "never", "lt": "it"}
    assert lexicon.corrections(counts, block=2).where("rank = 0").count() == 3  # block by block finds the same
    pages = spark.createDataFrame([("red car here. the cat sat. red car",)], "text string")
    asked = spark.createDataFrame([(1, 0, "ca7", "red", "here"), (1, 1, "ca7", "the", "sat")], "result_id long, line_no int, word string, before string, after string")
    ranked = spark.createDataFrame([("ca7", "car", 1.0), ("ca7", "cat", 1.1), ("x1", "xl", 2.0)], "word string, fix string, score double")
    assert {(r.line_no, r.fix) for r in lexicon.in_context(pages, asked, ranked, 3.0).collect()} == {(0, "car"), (1, "cat")}
    assert lexicon.in_context(pages, asked.where("word = 'x'"), ranked.where("word = 'x1'"), 3.0) is None


def test_page_numbers():
    for line, page in (("12", 12), ("— l2 —", 12), ("[l3]", 13), ("Page S", 5), ("p. 9", 9), ("· iv ·", 4), ("  23", 23), ("30.", 30), ("- 2o -", 20)):
        assert pagetext.is_page_number(line, page), line
    long = "[" * 30 + "12" + "]" * 60
    for line, page in (("cdxii", 412), ("mdccclxxxviii", 1888), (long, 12), ("." * 50_000 + " 7", 7)):
        assert pagetext.is_page_number(line, page), line[:40]
    for line, page in (("II", 2), ("13", 12), ("In 1867", 1867), ("", 1), ("7 ways", 7), ("x", None)):
        assert not pagetext.is_page_number(line, page), line
    assert pagetext.skeleton("THE CANDLF-LIT SECRETARY") == pagetext.skeleton("The Candle-Lit Secretary")
    assert pagetext.skeleton("The Nervous C1ock") == pagetext.skeleton("The Nervous Clock")


RESULTS = "result_id long, book_id string, site string, page int, page_role string, title string, page_continues_previous boolean, text string"


def small_book():
    filler = "The old garden kept the candle while the evening kept the other garden.\n" * 3
    rows = [(i, "f", "s", i, "body", None, False, filler + f"\n{i}") for i in range(100, 140)]
    rows += [
        (1, "b", "s", 1, "body", "The Old Garden", False, "# The Old Garden\n\nThe evening kept the gar-\nden and a wide-\nopen candle, wide-open again, a wide-open one, a wide-open two and wide-open three. The can-\n\n1"),
        (2, "b", "s", 2, "body", "The Old Garden", True, "THE 0LD GARDEN   2\ndle kept the evcning.\n\nNew part."),
        (3, "b", "s", 3, None, "The Old Garden", False, "The Old Garden\nThe candle stands. The evening sto"),
        (4, "b", "s", 5, "toc", None, None, "Contents\n9"), (5, None, None, None, None, None, None, None), (6, "b", "s", 6, "body", None, None, ""),
    ]
    return rows + rows[-4:]


def test_page_text(spark):
    pages = spark.createDataFrame(small_book(), RESULTS).withColumns({"kind": F.lit("clash"), "line_no": F.lit(0), "word": F.lit("w")})
    books = spark.createDataFrame([("b", "A Book"), ("b", None), (None, "x")], "book_id string, title string")
    got = {(r.result_id, r.line_no, r.kind) for r in pagetext.found_lines(pages, books).collect()}
    assert {x for x in got if x[0] < 100} == {(1, 2, "hyphen"), (1, 4, "hyphen"), (1, 6, "page_number"), (2, 0, "header"), (2, 1, "misread"), (3, 0, "header")}
    assert {x[1:] for x in got if x[0] >= 100} == {(4, "page_number")}
    paras = {(r.page, r.para_no): r.text for r in pagetext.paragraphs(pages, books).where("book_id = 'b'").collect()}
    assert paras[1, 1].endswith("The candle kept the evening.") and "the garden and a wide-open candle" in paras[1, 1] and paras[2, 1] == "New part."
    ends = truncation.found(pages, spark.createDataFrame([], "note_id long, site string, text string"), books)
    assert {(r.field, r.row_id) for r in ends.collect()} == {("page_text", 3)}


def test_headers_are_titles_or_recur(spark):
    """A line in capitals is a header if it is a title, misread or not, or heads other pages too; else it is text."""
    text = "{0}\nThe evening kept the garden and the candle.\nIt was late."
    rows = [
        (1, "b", "s", 1, "body", "My title", False, text.format("DO NOT ENTER")), (2, "b", "s", 2, "body", "My title", False, text.format("MY T1TLE   2")),
        (3, "b", "s", 3, "body", None, True, text.format("A LOST CHAPTER   3")), (4, "b", "s", 4, "body", None, True, text.format("A L0ST CHAPTER")),
        (5, "b", "s", 5, "body", None, True, text.format("THE " + "VERY " * 30 + "LONG TITLE")), (6, "b", "s", 6, "body", "The " + "very " * 30 + "long title", False, text.format("It began.")),
        (7, "c", "s", 1, "body", None, True, text.format("MY TITLE")), (8, "b", "s", 7, "body", None, True, text.format("THE MATHEMATICS   7")), (9, "b", "s", 8, "body", "The Mathematics", True, text.format("It began.")),
    ]
    got = {(r.result_id, r.line_no) for r in pagetext.found_lines(spark.createDataFrame(rows, RESULTS), spark.createDataFrame([], "book_id string, title string")).where("kind = 'header'").collect()}
    assert got == {(2, 0), (3, 0), (4, 0), (5, 0), (8, 0)}


def test_every_page_and_block(spark):
    """Front matter and lists give paragraphs, and blocks come out repaired, those without text too."""
    block = "array<struct<type string, level int, text string>>"
    pages = spark.createDataFrame([(*r, None) for r in small_book()] + [
        (50, "b", "s", 9, "front_matter", None, None, "THE OLD GARDEN\n\nThe evcning kept the gar-\nden.\n9", [("heading", 1, "THE OLD GARDEN"), ("paragraph", 0, "The evcning kept the gar-\nden and the gar- den, the can-"), ("quote", 0, None)]),
    ] * 2, RESULTS + f", blocks {block}")
    books = spark.createDataFrame([("b", "A Book")], "book_id string, title string")
    paras = {(r.page, r.para_no): r.text for r in pagetext.paragraphs(pages, books).where("book_id = 'b'").collect()}
    assert paras[9, 0] == "THE OLD GARDEN" and paras[9, 1] == "The evening kept the garden." and paras[5, 0] == "Contents 9"
    rows = sorted(tuple(r) for r in pagetext.repaired_blocks(pages, books).collect())
    assert [r[:6] for r in rows] == [(50, "b", 9, 0, "heading", 1), (50, "b", 9, 1, "paragraph", 0), (50, "b", 9, 2, "quote", 0)]
    assert [r[6] for r in rows] == ["THE OLD GARDEN", "The evening kept the garden and the garden, the can-", None]


# ---- truncation -------------------------------------------------------------------------------------------------------


def test_note_limits(spark):
    whole = [(i, "s", f"The word for garden also means an evening, shelf {i}." if i % 2 else f"The word for a lamp, leaf {i}" + "." * (i % 4 == 0)) for i in range(60)]
    cut = [(1000 + i, "s", ("Compare the long history of the garden in volume " + "abcdefghij"[i % 10] * 40)[:60]) for i in range(20)]
    notes = whole + cut + [(2000, "s", "The translator left the gar"), (2001, "s", None), (2002, None, ""), (2003, "s", "ｓhelf ９．")]
    df = spark.createDataFrame(notes + notes[:5], "note_id long, site string, text string")
    ends = truncation.judged_endings(df)
    lim = truncation.limits(ends.select(F.lit("note").alias("field"), "site", "text", F.expr("unfinished AND NOT complete").alias("unfinished"))).collect()
    assert [(r.encoding, r.n_limit, r.n_at) for r in lim] == [("characters", 60, 20)]
    pages = spark.createDataFrame([], RESULTS)
    got = truncation.found(pages, df, spark.createDataFrame([], "book_id string, title string"))
    assert {r.row_id for r in got.collect()} == {n for n, _, _ in cut} | {2000}
    shares = {(r.field, r.site): (r.n_records, r.n_cut) for r in truncation.site_shares(pages, df, got).collect()}
    assert shares["note", "s"] == (82, 21)


def test_length_encodings(spark):
    import html
    import json

    t = "a&b\n\"é\\😀"
    got = spark.createDataFrame([(t,)], "t string").select(*(c.alias(k) for k, c in truncation.lengths(F.col("t")).items())).collect()[0]
    assert got.characters == 8 and got.utf8 == len(t.encode()) and got.utf16 == len(t.encode("utf-16-le")) // 2 and got.crlf == 9
    assert got.entities == len(t.replace("&", "&amp;").replace('"', "&quot;")) and got.json == 11
    rng = random.Random(6)
    pool = [*map(chr, range(0, 0x180)), "\U0001f600", "\U00010000", "\uffff", "漢", "\r\n", "'", "<", ">"]
    texts = ["\U0001f600\x01", "", *("".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400))]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *(c.alias(k) for k, c in truncation.lengths(F.col("t")).items())).collect()
    for r in rows:
        t = r.t
        want = (len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2, len(html.escape(t)), len(json.dumps(t, ensure_ascii=False)) - 2, len(json.dumps(t)) - 2, len(re.sub("(?<!\r)\n", "\r\n", t)))
        assert tuple(r)[1:] == want, t


@pytest.mark.parametrize("encoding", ["characters", "utf8", "entities", "json_ascii"])
def test_limits_of_any_encoding_decide(spark, encoding):
    """Texts at their source's limit are cut though their last words look complete, under whatever encoding it stores by."""
    import html
    import json

    size = {"characters": len, "utf8": lambda t: len(t.encode()), "entities": lambda t: len(html.escape(t)), "json_ascii": lambda t: len(json.dumps(t)) - 2}[encoding]
    rng = random.Random(3)

    def stored(end: str, limit: int) -> str:
        """A text of exactly ``limit`` units that ends so, of a length in characters of its own."""
        while True:
            t = "".join(rng.choice("abcdefgé&'  ") for _ in range(rng.randrange(20, limit))) + end
            while size(t) < limit:
                t = "a" + t
            if size(t) == limit:
                return t

    whole = [(i, "s", f"He wrote of the garden at evening{'.' if i % 3 else ''}") for i in range(90)]
    cut = [(500 + i, "s", stored(f" qua{'bcdfghjklm'[i]}", 90)) for i in range(10)]
    hidden = [(600 + i, "s", stored(" at evening", 90)) for i in range(4)]
    near = [(700, "s", stored(" at evening", 89)), (701, "s", stored(" at evening", 91))]
    df = spark.createDataFrame(whole + cut + hidden + near, "note_id long, site string, text string")
    empty = spark.createDataFrame([], RESULTS)
    books = spark.createDataFrame([], "book_id string, title string")
    lim = truncation.limits(truncation.records(empty, df, books)).collect()
    assert [(r.field, r.encoding, r.n_limit) for r in lim] == [("note", encoding, 90)]
    assert {r.row_id for r in truncation.found(empty, df, books).collect()} == {n for n, _, _ in cut + hidden}


def test_page_limits_decide(spark):
    """A page that ends with what looks like a heading is cut if it is as long as its source's limit."""
    def page(i, end, n):
        return (i, "b%d" % i, "s", 1, "body", None, False, ("The old garden kept the candle. " * 9 + "\n")[-(n - len(end)):] + end)

    rows = [page(i, "the gar", 200) for i in range(8)] + [page(20, "\nChapter II: The Ga", 200), page(21, "\nChapter II: The Ga", 190), page(22, "It ended.", 200)]
    df = spark.createDataFrame(rows, RESULTS)
    got = truncation.found(df, spark.createDataFrame([], "note_id long, site string, text string"), spark.createDataFrame([], "book_id string, title string"))
    assert {r.row_id for r in got.collect()} == {*range(8), 20}


# ---- messages ---------------------------------------------------------------------------------------------------------

RAW = (
    "From: =?utf-8?q?Ann_M=C3=BCller?= <a@x.example>\r\nContent-Type: multipart/mixed;\r\n boundary=\"bb\"\r\n\r\nPreamble\r\n--bb\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n"
    "Gr=C3=BC=\r\n=C3=9Fe to =\r\nall=20\r\n> quoted here\r\n--bb\r\nContent-Type: text/html\r\n\r\n<p>one <b>tw</b>o &amp; three</p>\r\n--bb\r\nContent-Type: text/plain; name=\"x.txt\"\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    "aGVsbG8gd29y\r\n!!bGQ=\r\n--bb\r\nContent-Type: application/octet-stream\r\nContent-Transfer-Encoding: base64\r\n\r\nAAAA"
)


def test_message_parts():
    shown = mail.shown(RAW)
    assert "Grüße to all" in shown and "\nquoted here" in shown and "one two & three" in shown and "hello world" in shown and "AAAA" not in shown and "Preamble" not in shown
    first = mail.parts(RAW)[0].lines[0]
    assert first.text.startswith("Grüße") and [n for _, n in first.origin] == [9, 10, 11]
    assert mail.parts(None) == mail.parts("") == mail.parts("no body") == [] and mail.shown("A: b\n\nplain > text") == "plain > text"
    assert pii.header_names(RAW) == [["Ann", "Müller"]]


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, "s", " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30))), "A") for i in range(12)] + [(90, "s", None, None), (91, "s", "...", "")]
    docs = []
    for d in range(60):
        base = [rng.choice(vocab) for _ in range(30)]
        own = items[rng.randrange(12)][2].split()
        a = rng.randrange(len(own))
        part = own[a : a + rng.choice([5, 11, 12, 13, 40])]
        docs.append((d, "A: b\n\n" + " ".join(base[:10]) + "\n> " + ", ".join(w.upper() for w in part) + "\n" + " ".join(base[10:])))
    docs += [(900, None), (901, ""), (902, "A: b\n\n" + "w1 " * 100_000)]
    squash = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = set()
    for d, text in docs:
        body = squash(mail.shown(text)) if text else ""
        for i, _, q, _ in items:
            w = squash(q or "").split()
            n = min(12, len(w))
            if n and any(" " + " ".join(w[k : k + n]) + " " in body for k in range(len(w) - n + 1)):
                want.add((d, i))
    df = spark.createDataFrame(docs + docs[:9], "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, suite string, text string, answer string")
    assert {tuple(r) for r in leaks.found(df, it).collect()} == want
    assert leaks.found(df, it.where("item_id < 0")).count() == 0
    every = leaks.passages(df, it).distinct().collect()
    for r in every:
        raw = dict(docs)[r.doc_id]
        text = mail.shown(raw)
        own = [w.lower() for w in re.findall(r"[^\W_]+", text[r.start : r.end])]
        assert len(own) == r.n_words and own == items[r.item_id][2].split()[r.item_word : r.item_word + r.n_words]
        assert leaks.words(raw[r.raw_start : r.raw_end].replace("> ", "")) == own
    assert set(leaks.passages(df, it, limit=20).distinct().collect()) == set(every)  # any number of automata
    assert {r.item_id for r in leaks.leaked_items(df, it).where("n_docs > 0").collect()} == {i for _, i in want}


def test_passages_go_on_in_text_and_item(spark):
    """An item's second half before its first is two passages, not one; letters that grow when lower-cased move nothing."""
    w = [f"w{i}" for i in range(24)]
    docs = spark.createDataFrame([(1, "A: b\n\nİİİ " + " ".join(w[12:] + w[:12])), (2, "A: b\n\n" + " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(5, "s", " ".join(w), None)], "item_id long, suite string, text string, answer string")
    rows = sorted((r.doc_id, r.first_word, r.n_words, r.item_word, r.raw_start) for r in leaks.passages(docs, items).collect())
    assert rows == [(1, 1, 12, 12, 10), (1, 13, 12, 0, 10 + len(" ".join(w[12:])) + 1), (2, 0, 24, 0, 6)]
    (item,) = leaks.leaked_items(docs, items.withColumn("answer", F.lit("a short one"))).collect()
    assert (item.n_docs, item.longest, item.short_answer) == (2, 24, True)


def test_raw_offsets_of_all_encodings(spark, small):
    import base64

    passage = "one two three four five six seven eight nine ten eleven zwölf"
    html = "<p>intro</p><!-- no --><div>" + passage.replace("six", "<b>six</b>").replace("ö", "&ouml;") + "</div>"
    coded = base64.encodebytes(("Hallo\n" * 20 + passage + "\nend" * 20).encode()).decode()
    soft = "Hallo =C3=B6\n" + passage.replace("ö", "=C3=B6").replace("seven ", "seven =\n") + "\nend"
    head = "A: b\r\nContent-Type: text/{0}\r\nContent-Transfer-Encoding: {1}\r\n\r\n"
    raws = [head.format("plain", "8bit") + "> intro\r\n> " + passage + "\r\nend", head.format("html", "8bit") + html, head.format("plain", "base64") + coded, head.format("plain", "quoted-printable") + soft, RAW]
    items = spark.createDataFrame([(5, "s", passage, None)], "item_id long, suite string, text string, answer string")
    got = {r.doc_id: r for r in leaks.passages(spark.createDataFrame(list(enumerate(raws)), "doc_id long, text string"), items).collect()}
    assert set(got) == {0, 1, 2, 3}
    part = {k: raws[k][r.raw_start : r.raw_end] for k, r in got.items()}
    assert part[0] == passage and mail.strip_markup(part[1]) == passage and part[3] == soft.split("\n", 1)[1].removesuffix("\nend")
    assert passage in mail.undo_base64(part[2].split("\n")) and len(part[2]) < 250
    for r in table(spark, small, "documents").select("text").collect() + [(x,) for x in raws]:
        back = mail.traced(r[0])
        assert back.text == mail.shown(r[0]) and len(back.text) == len(back.starts) == len(back.ends)


# ---- packing ----------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_tokenizer(spark, small):
    from pathlib import Path

    counter = packing.TokenCounter(Path(packing.TOKENIZERS, packing.VOCABULARY).read_bytes())
    odd = ["", "a  b\n\n c", "it's 12²½ don't_x", "naïve “quoted” — 漢字", " \t\n ", "x" * 5000, "A1B2 __ --- ...\r\n"]
    for t in odd + [r.text for r in table(spark, small, "documents").select("text").limit(40).collect()]:
        assert counter.count(t) == len(counter.encode(t)), t[:50]
    assert counter.count(None) == 0


@pytest.mark.parametrize("shard", [7, 40_000])
def test_packing(spark, shard):
    rng = random.Random(11)
    counts = [(i, rng.choice([0, 1, 5, 30, 64, 65, 100, rng.randrange(1, 400)])) for i in range(400)]
    df = spark.createDataFrame(counts, "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, 0)], "capacity_id int, tokens int")
    rows = packing.pack(df, caps, groups=8, shard=shard).collect()
    for cap_id, cap in ((1, 100), (2, 64)):
        own = [r for r in rows if r.capacity_id == cap_id]
        fill = {}
        for r in own:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
        assert max(fill.values()) <= cap
        for d, n in counts:
            got = sorted((r.start_token, r.tokens) for r in own if r.doc_id == d)
            assert sum(t for _, t in got) == n and (len(got) <= 1 or n > cap)
            assert all(a + t == b for (a, t), (b, _) in zip(got, got[1:]))
    rates = packing.fill_rates(spark.createDataFrame(rows)).collect()
    assert all(r.fill > (0.85 if shard > 7 else 0.6) for r in rates)
    assert packing.pack(df.where("tokens < 0"), caps).count() == 0


def test_many_capacities_are_packed_whole(spark):
    """More sizes than one pass takes, all packed; and plans of many rounds use every piece."""
    counts = spark.createDataFrame([(i, 1 + i % 40) for i in range(60)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(k, 50 + k) for k in range(70)], "capacity_id int, tokens int")
    placed = packing.pack(counts, caps).groupBy("capacity_id").agg(F.sum("tokens").alias("t")).collect()
    assert {r.capacity_id: r.t for r in placed} == {k: sum(1 + i % 40 for i in range(60)) for k in range(70)}
    groups = [(s, 1 + s % 7) for s in range(600, 9000, 3)]
    plan = packing.configurations(groups, 9000)
    used = np.zeros(len(groups), int)
    for take, times in plan:
        used += np.array(take) * times
    assert len(plan) > 2000 and used.tolist() == [n for _, n in groups]


def test_configurations_use_every_piece():
    rng = random.Random(1)
    for _ in range(20):
        groups = sorted({rng.randrange(10, 100): rng.randrange(1, 50) for _ in range(6)}.items())
        used = [0] * len(groups)
        for take, times in packing.configurations(groups, 100):
            assert sum(t * s for t, (s, _) in zip(take, groups)) <= 100 and times > 0
            used = [u + t * times for u, t in zip(used, take)]
        assert used == [n for _, n in groups]


# ---- personal values --------------------------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    import numpy as np

    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(9, 8)).astype(np.float32), rng.normal(size=(8, 8)).astype(np.float32)
    bounds = [(0, 3), (3, 4), (4, 6), (6, 9)]
    got, expected = pii.marginals(e, trans, bounds, pairs=True)
    total = np.zeros_like(trans)
    for lo, hi in bounds:
        weights = {}
        for y in itertools.product(range(8), repeat=hi - lo):
            s = sum(e[lo + i, l] for i, l in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
            weights[y] = np.exp(s)
        z = sum(weights.values())
        for i in range(hi - lo):
            p = np.array([sum(w for y, w in weights.items() if y[i] == l) for l in range(8)]) / z
            assert np.allclose(np.exp(got[lo + i]), p, atol=1e-4)
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                total[a, b] += w / z
    assert np.allclose(total, expected, atol=1e-3)


def test_lattice_against_passes_along_each_chain():
    """Blocks side by side give what a pass along every chain gives, also after scores change."""
    rng = np.random.default_rng(3)
    cuts = np.cumsum([0, 1, 700, 2, 127, 128, 129, 1, 300])
    bounds = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    e, trans = rng.normal(size=(cuts[-1], 8)).astype(np.float32) * 3, rng.normal(size=(8, 8)).astype(np.float32) * 2
    lattice = pii.Lattice(e, trans, bounds)
    assert np.allclose(lattice.belief(), np.exp(pii.marginals(e, trans, bounds)), atol=1e-4)
    some = np.array([0, 5, 400, 701, 830, 1387])
    e[some] = rng.normal(size=(len(some), 8)) * 5
    lattice.set(some, e[some])
    want = np.exp(pii.marginals(e, trans, bounds))
    assert np.allclose(lattice.belief(), want, atol=1e-4) and np.allclose(lattice.belief(some), want[some], atol=1e-4)


def test_streets_begin_with_their_number():
    """A street whose number was left out by a narrow margin begins with it; a town below its street begins nothing."""
    def found(text, labels):
        c = pii.chain(text, 0, len(text))
        return [(v.kind, text[v.start : v.end]) for v in pii.entities(c.starts, c.ends, c.spots, labels, text, 0)]

    i, b = pii.I_ADDR, pii.B_ADDR
    assert found("at 37 Alder St.", [0, 0, i, i, i]) == [("address", "37 Alder St")]
    assert found("3 Quay Road\n25405 Dungate", [b, i, i, 0, i]) == [("address", "3 Quay Road")]
    assert found("the Alder Road", [0, i, i]) == [] and found("no 7, Alder Road", [0, 0, 0, i, i]) == []


def test_word_nodes():
    """Equal, inflected and similar words of one message share a node; words of other messages and short ones do not."""
    types = pii.Types(np.zeros((pii.BUCKETS, len(pii.LABELS)), np.float32))
    words = ["Müller", "the", "Muller's", "Greta", "Gretta", "Hall", "Hill", "Müller", "Greta"]
    docs = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1])
    token, hub = pii.word_nodes(types, np.array([types.id(w) for w in words]), docs)
    groups = {frozenset(token[hub == h].tolist()) for h in set(hub.tolist())}
    assert groups == {frozenset({0, 2}), frozenset({3, 4})}
    assert pii.word_nodes(types, np.zeros(0, np.int64), np.zeros(0, np.int64))[0].size == 0


def test_agreement_settles_words():
    """A word that nothing tells at one place is told by its other occurrences, and only through the word node."""
    w, trans = np.zeros((pii.BUCKETS, len(pii.LABELS)), np.float32), np.zeros((8, 8), np.float32)
    w[list(pii.SPOTS.values()), pii.O] = 0.5
    w[pii.relation(np.array(pii.type_features("dear")[1]), -1)[0], pii.B_NAME] = 6
    raw = "From: a <a@x.example>\n\ndear Wrelka of the words\n\nit was Wrelka there\n\nand Wrelkas too\n\nand Sundholt\n"
    names = lambda skip: sorted(own[v.body].clean[v.start : v.end] for own, values in pii.Finder(pii.Model(w, trans, skip)).find([raw]) for v in values if v.kind == "name")
    assert names(0.0) == ["Wrelka"] and names(2.0) == ["Wrelka", "Wrelka", "Wrelkas"]


def test_tokens_do_not_depend_on_segments():
    """Numbers and addresses that reach over a line's end stay whole; other lines stand alone."""
    text = "Call +44\n7700 900 181 now\nor write to ann\nat home dot example\n\n\nAB 12 34 56\nC\nthe end\n"
    assert [t for _, t, _ in pii.segments(text, 0, len(text))] == ["Call +44\n7700 900 181 now", "or write to ann\nat home dot example", "AB 12 34 56\nC", "the end"]
    part = pii.chain(text, 0, len(text))
    assert "ann\nat home dot example" in part.tokens and "AB 12 34 56\nC" in part.tokens and [text[a:b] for a, b in zip(part.starts, part.ends)] == [t if t != "\n" else "" for t in part.tokens]
    assert pii.TOKENS.match("me at 555.555.0154")[0] == "me"
    rng = random.Random(12)
    pool = ["ann", "at", "AT", "home", ".", "dot", "example", "@", "12", "+44", " ", " ", "(", ")", "[at]", "A1234567", "O'Neil", "é", "_x", "-", "\n"]
    for _ in range(3000):  # patterns tried only where their signs stand give the same tokens
        line = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))
        found = list(pii.TOKENS.finditer(line))
        assert pii.scanned(line)[:2] == ([m[0] for m in found], [m.lastindex for m in found]), line


@pytest.fixture(scope="module")
def finder(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = {r.text for r in docs.where("doc_id > 900").select("text").collect()}
    texts = [t for t in pii.sample(docs, 500) if t not in held]
    return pii.Finder(pii.train(texts)), sorted(t for t in held if t)


def test_held_out_values(finder):
    """On messages outside the sample, lines with values by header names and shapes are found, and few others."""
    model, held = finder
    names = frozenset(w.lower() for raw in held for ws in pii.header_names(raw) for w in ws if len(w) > 2)
    hit = missed = extra = 0
    for raw, (own, values) in zip(held, model.find(held, False)):
        want = set()
        for k, b in enumerate(own):
            for lo, hi in pii.stretches(b.clean, set()):
                part = pii.chain(b.clean, lo, hi)
                if part.tokens:
                    want |= {(b.raw_line(v.start), v.kind) for v in pii.entities(part.starts, part.ends, part.spots, pii.gold(b.clean, part, names), b.clean, k)}
        got = {(own[v.body].raw_line(v.start), v.kind) for v in values}
        hit += len(want & got)
        missed += len(want - got)
        extra += len({x for x in got - want if x[1] != "name"})  # names beyond these headers are no mistakes
    assert hit / (hit + missed) > 0.95 and extra / (hit + extra) < 0.03


def test_redaction(finder):
    model, _ = finder
    raw = "From: Greta Wickovan <g@x.example>\n\nDear Stellan,\n\nOrder no. 5594347749 left. The reply goes to greta.wickovan (at) post.invalid today.\nNew number: +44 7700 900181. Call Greta Wickovan, tel 07700 900 121.\n\n-- \nGreta Wickovan\nTel. 030 23125-044\n205 Quay Road\nFalmere 12345\n"
    ((own, values),) = model.find([raw])
    kinds = {v.kind for v in values}
    assert {"name", "email", "phone", "address"} <= kinds
    assert not any("5594347749" in own[v.body].clean[v.start : v.end] for v in values)
    assert model.find([None, "", "no body", "A: b\n\n" + "Call Greta. " * 20_000])[0] == ([], [])


def test_neighbours_make_names(finder):
    """A word whose own weights speak against a name is one where its neighbours say so; no line goes unasked."""
    model, _ = finder
    w = np.zeros((pii.BUCKETS, len(pii.LABELS)), np.float32)
    w[list(pii.SPOTS.values()), pii.O] = 1
    w[pii.bucket("cw=hollow"), pii.O] = 6
    w[pii.relation(np.array(pii.type_features("dear")[1]), -1)[0], pii.B_NAME] = 20
    fixed = model.model._replace(weights=w, trans=np.zeros_like(model.model.trans))
    ((own, values),) = pii.Finder(fixed).find(["From: a <a@x.example>\n\nsome words\n\ndear Hollow of the words\n\nmore words\n"])
    assert [(v.kind, own[v.body].clean[v.start : v.end]) for v in values] == [("name", "Hollow")]


# ---- all queries --------------------------------------------------------------------------------------------------------


def changed(spark, small, tmp_path, rule):
    import os

    for name in ("page_results", "page_notes", "books", "documents", "eval_items", "pack_capacities"):
        rule(name, table(spark, small, name)).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    return str(tmp_path)


FOUND = sorted(k for k in llm_queries.QUERIES if not k.endswith(("_limits",)))


@pytest.fixture(scope="module")
def empty_dir(spark, small, tmp_path_factory):
    return changed(spark, small, tmp_path_factory.mktemp("empty"), lambda name, df: df.limit(0))


@pytest.fixture(scope="module")
def odd_dir(spark, small, tmp_path_factory):
    keys = {"page_results": ["result_id"], "page_notes": ["note_id"], "books": [], "documents": ["doc_id"], "eval_items": ["item_id"], "pack_capacities": ["capacity_id"]}

    def rule(name, df):
        """Rows as they are, the same with nulls in all columns but the key, some twice, and columns with clashing names."""
        if name == "pack_capacities":
            return df
        few = df.limit(120)
        shift = 10_000_000
        holes = few.limit(15).select(*((F.col(c) + shift if keys[name] and c in keys[name] else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes))
        return few.unionByName(few.limit(20)).unionByName(holes).withColumns({c: F.lit("clash") for c in ("word", "n", "fix", "skel", "tokens", "container", "line", "boiler", "what") if c not in df.columns})

    return changed(spark, small, tmp_path_factory.mktemp("odd"), rule)


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables(spark, empty_dir, name):
    assert llm_queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", FOUND)
def test_odd_tables(spark, odd_dir, name):
    df = llm_queries.QUERIES[name](spark, odd_dir)
    rows = df.collect()
    assert len(rows) == len(set(map(str, rows)))
