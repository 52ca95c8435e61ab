"""Held-out test items inside messages.

All word sequences that count as a leak go into one Aho-Corasick automaton. Text and items are brought to words (runs
of letters and digits, case ignored); every word that an item uses becomes one character, any other word a filler, so
that the automaton runs over one character a word, and a hit's offset is a word's number in the text. Hits that go on
both in the text and in the item are one passage; its offsets are given in the shown and in the raw text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import mail

#: Consecutive words of an item that make a leak; a shorter item must stand whole.
MIN_WORDS = 12
#: Words of items in one automaton, which keeps every word's character below the filler; more items make more automata.
BLOCK_WORDS = 900_000
WORD = re.compile(r"[^\W_]+")
FILLER = "\U0010ffff"


def words(text: str | None) -> list[str]:
    return [w.lower() for w in WORD.findall(text)] if text else []


class Items:
    """Test items as word sequences and the automaton over their windows."""

    def __init__(self, items: list[tuple[int, str, str | None]], min_words: int = MIN_WORDS):
        self.items, self.min_words = items, min_words
        self.machine = None

    def build(self) -> None:
        self.letters: dict[str, str] = {}
        machine = ahocorasick.Automaton()
        for item_id, question, answer in self.items:
            both = words(question)
            if answer and len(words(answer)) >= self.min_words:  # shorter answers occur in any text
                sources = (both, words(answer))
            else:
                sources = (both,)
            for source, tokens in enumerate(sources):
                if not tokens:
                    continue
                key = "".join(self.letters.setdefault(w, chr(0x4E00 + len(self.letters)) if len(self.letters) < 0x5000 else chr(0x20000 + len(self.letters))) for w in tokens)
                size = min(self.min_words, len(key))
                for i in range(len(key) - size + 1):
                    window = key[i : i + size]
                    owners = machine.get(window, None)
                    if owners is None:
                        machine.add_word(window, (size, [(item_id, source, i)]))
                    else:
                        owners[1].append((item_id, source, i))
        if len(machine):
            machine.make_automaton()
        self.machine = machine

    def hits(self, tokens: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """item_id -> [(start, end, word of the item)]: word ranges of the text that stand so in the item, each as long as
        text and item go on together; ranges within others are left out."""
        if self.machine is None:
            self.build()
        if not len(self.machine):
            return {}
        get = self.letters.get
        line = "".join([get(w, FILLER) for w in tokens])
        runs: dict[tuple[int, int, int], list[list[int]]] = {}
        for end, (size, owners) in self.machine.iter(line):
            start = end + 1 - size
            for item, source, at in owners:
                own = runs.setdefault((item, source, start - at), [])
                if own and start <= own[-1][1]:
                    own[-1][1] = end + 1
                else:
                    own.append([start, end + 1, at])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for (item, _, _), own in runs.items():
            found.setdefault(item, []).extend(map(tuple, own))
        for item, own in found.items():
            own.sort(key=lambda r: (r[0], -r[1], r[2]))
            whole: list[tuple[int, int, int]] = []
            for r in own:
                if not whole or r[1] > whole[-1][1]:
                    whole.append(r)
            found[item] = whole
        return found


FIELDS = "doc_id bigint, item_id bigint, first_word int, n_words int, item_word int, start int, end int, raw_start int, raw_end int"
SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.endswith("bigint") else pa.int32()) for f in FIELDS.split(", ")])
Item = tuple[int, str, str | None]


def blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The items in blocks of bounded size, one at a time."""
    own: list[Item] = []
    size = 0
    for r in items.select("item_id", "text", "answer").where("text IS NOT NULL AND item_id IS NOT NULL").distinct().orderBy("item_id").toLocalIterator():
        more = len(words(r.text)) + len(words(r.answer))
        if own and size + more > limit:
            yield own
            own, size = [], 0
        own.append((r.item_id, r.text, r.answer))
        size += more
    yield own


def passages(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, limit: int = BLOCK_WORDS, offsets: bool = True) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, item_word, start, end, raw_start, raw_end): every stretch of a message's shown
    text that is in an item.

    ``first_word`` counts words of the shown text, ``item_word`` those of the item; ``start`` and ``end`` are characters of
    the shown text, ``raw_start`` and ``raw_end`` of the raw one, where encoded lines count whole. Null and empty texts have
    none; a message given twice gives its rows twice. A block of items, of bounded size, goes to every task; each text is
    scanned once a block. Without ``offsets`` the character columns stay null.
    """
    sc = docs.sparkSession.sparkContext

    def scan(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Items(shared.value, min_words)
            for batch in batches:
                flat = []
                for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not raw:
                        continue
                    text = mail.shown(raw)
                    found = machine.hits(words(text))
                    if not found:
                        continue
                    if not offsets:
                        flat += [(doc_id, item, a, b - a, at, *[None] * 4) for item, runs in found.items() for a, b, at in runs]
                        continue
                    spans = [m.span() for m in WORD.finditer(text)]
                    back = mail.traced(raw)
                    for item, runs in found.items():
                        for a, b, at in runs:
                            start, end = spans[a][0], spans[b - 1][1]
                            flat.append((doc_id, item, a, b - a, at, start, end, back.starts[start], back.ends[end - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ([],) * 9, SCHEMA.types)], schema=SCHEMA)

        return docs.select("doc_id", "text").mapInArrow(run, FIELDS)

    return reduce(DataFrame.unionByName, (scan(sc.broadcast(b)) for b in blocks(items, limit)))


def found(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id) of every message that holds an item or ``min_words`` consecutive words of it."""
    return passages(docs, items, min_words, offsets=False).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, suite, n_docs, longest, short_answer): every item, with the messages it leaks into and its longest stretch
    in words; ``short_answer``: its answer has too few words to be looked for apart."""
    hit = passages(docs, items, min_words, offsets=False).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    n = F.size(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    own = items.groupBy("item_id", "suite").agg(F.max((n > 0) & (n < min_words)).alias("short_answer"))
    return own.join(hit, "item_id", "left").fillna(0, ["n_docs", "longest"]).select("item_id", "suite", "n_docs", "longest", "short_answer")
