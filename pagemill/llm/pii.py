"""Personal values in message bodies: found by a skip-chain conditional random field, replaced by typed placeholders.

Tokens of a message form a chain; all occurrences of equal or similar capitalised words of a message are joined through one
node a word, so that a name known from a signature settles the same name, or a misspelt or inflected form of it, anywhere
in the message. Chain weights are fitted on the driver by gradient ascent on the chain likelihood over a bounded sample of
messages, labelled by their own headers (display names), and by the shapes of values after their cue words; the weight of
agreement by the likelihood of a part of the sample that the weights have not seen. Inference is message passing along
chains and over the word nodes until no belief changes, vectorised over all messages of an Arrow batch; it runs over every
line.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import mail as messages

LABELS = ("O", "B-name", "I-name", "email", "phone", "id_number", "B-address", "I-address")
O, B_NAME, I_NAME, EMAIL, PHONE, ID, B_ADDR, I_ADDR = range(len(LABELS))
KIND = ("", "name", "name", "email", "phone", "id_number", "address", "address")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in ("name", "email", "phone", "id_number", "address")}

#: Messages in the sample the weights are fitted on, passes over it, and its seed.
SAMPLE_DOCS, EPOCHS, SEED = 600, 8, 7
#: Of the sample's lines without any sign of a value, one in so many is learned from.
PLAIN_LINES = 2
#: Hashed features (the model is this times the number of labels, whatever the corpus).
BUCKETS = 1 << 17
#: Messages inferred at a time; tokens of a block that is passed over beside all others.
BATCH_DOCS, BLOCK = 768, 128
#: Messages along a chain are settled within SETTLED, beliefs within MOVED; most rounds over the word nodes.
SETTLED, MOVED, MOST_ROUNDS = 1e-5, 1e-3, 50
#: Share of the sample that the weight of agreement is fitted on, and passes over the rest for it.
HELD, HELD_EPOCHS = 1 / 3, 3
#: Weights of agreement that are tried.
SKIP_WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0)
#: Least letters of words that are similar by one edit.
SIMILAR_LETTERS = 5
#: Token types and stretches of lines a task remembers.
TYPES, REMEMBERED = 200_000, 150_000
#: Padded positions that are passed over at a time; saves memory where messages differ in length.
CELLS = 1 << 16
#: Characters of the lines before and after that a stretch of the sample takes along as context.
CONTEXT = 30

MAIL_NAME = r"[\w.+%-]*\w"
MAIL_AT = r"(?:@|[ \n]?[\[({<][ ]?(?:at|AT|@)[ ]?[\])}>][ \n]?|[ \n](?:at|AT)[ \n])"
MAIL_DOT = r"(?:\.|[ \n]?[\[({<][ ]?(?:dot|DOT)[ ]?[\])}>][ \n]?|[ \n](?:dot|DOT)[ \n])"
ADDRESS = rf"{MAIL_NAME}{MAIL_AT}[A-Za-z0-9-]+(?:{MAIL_DOT}[A-Za-z0-9-]+)*{MAIL_DOT}[A-Za-z][A-Za-z0-9-]*"
# Shapes of numbers that may be wrapped over lines, then any other number.
NUMBER = (
    r"(?<!\w)[A-Z]{2}(?:\s*\d\d){3}\s*[A-Z]\b|(?<!\w)[A-Z]\d{6,9}\b"
    r"|\+\d{1,3}\s+(?:\(0\)\d{3,5}\s+\d{4,7}|\d(?:\s+\d\d){4}|\d{3}\s+\d{3}\s+\d{4}|\d{4}\s+\d{6})"
    r"|\b0\d{4}\s+\d{3}\s+\d{3}\b|\(\d{3}\)\s+\d{3}-\d{4}|\b0\d{2,4}\s+\d{4,6}-\d{2,4}|\b\d\d(?:\s+\d{3}){3}\b"
    r"|\+?\(?\d[\d ().\-/:]*\d(?:[A-Z]\b)?|\+?\d+[A-Z]?"
)
WORDS_AND_SIGNS = r"([^\W\d_]+(?:['’-][^\W\d_]+)*|\w+)|([^\w\s]+)"
TOKENS = re.compile(rf"({ADDRESS})|({NUMBER})|{WORDS_AND_SIGNS}")
#: What every address, and every number, holds; without it their patterns are not tried.
AT_SIGN, DIGIT = re.compile(r"@|(?<![^\s\[({<])(?:at|AT)(?![^\s\])}>])"), re.compile(r"\d")
NEVER = "((?!))"
BY_SIGNS = {
    (True, True): TOKENS, (True, False): re.compile(rf"({ADDRESS})|{NEVER}|{WORDS_AND_SIGNS}"),
    (False, True): re.compile(rf"{NEVER}|({NUMBER})|{WORDS_AND_SIGNS}"), (False, False): re.compile(rf"{NEVER}|{NEVER}|{WORDS_AND_SIGNS}"),
}
MAIL, NUMERIC, WORD, SIGN = 1, 2, 3, 4
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*")
HOT = re.compile(r"[\d@]|[\[({<]\s?(?:at|AT)\b|[ \n](?:at|AT)[ \n][\w-]+(?:\.[a-z]|[ \n]?[\[({]?(?:dot|DOT)\b)")
MARKS = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
TAGS = re.compile(r"</?[a-zA-Z][^<>\n]*>")
ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
ENCODED = re.compile(r"=\?([^?]+)\?([bqBQ])\?([^?]*)\?=")


class Body(NamedTuple):
    """A text part: its text, the same text with marks and markup blanked, and where its stretches of raw lines begin."""

    text: str
    clean: str
    starts: list[int]
    numbers: list[int]

    def raw_line(self, offset: int) -> int:
        return self.numbers[bisect_right(self.starts, offset) - 1] if self.numbers else -1


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


def _entity(m: re.Match) -> str:
    import html

    shown = html.unescape(m[0])
    return (shown if len(shown) == 1 else " ") .ljust(len(m[0]))


def bodies(raw: str | None, encoded: bool = True) -> list[Body]:
    """The text parts of a message; parts in base64 have no raw lines and come only with ``encoded``."""
    out = []
    for part in messages.parts(raw):
        if part.encoding == "base64" and not encoded:
            continue
        text = "\n".join([x.text for x in part.lines])
        starts, numbers = [], []
        if part.encoding != "base64":
            at = 0
            for line in part.lines:
                for offset, number in line.origin:
                    starts.append(at + offset)
                    numbers.append(number)
                at += len(line.text) + 1
        clean = text
        if part.kind == "html":
            clean = TAGS.sub(_blank, clean)
            if "&" in clean:
                clean = ENTITY.sub(_entity, clean)
        if ">" in clean:
            clean = MARKS.sub(_blank, clean)
        out.append(Body(text, clean, starts, numbers))
    return out


# ---- features ---------------------------------------------------------------------------------------------------------

CUR, CTX = 8, 3
DIGITS = str.maketrans("0123456789", "9999999999")


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % (BUCKETS - 1) + 1


def type_key(token: str, kind: int) -> str:
    """Tokens with equal features share a type: mail addresses are one, numbers go by shape and first digits."""
    if kind == MAIL:
        return "@"
    if kind == NUMERIC:
        return f"#{' '.join(token.split()).translate(DIGITS)}|{token[:2]}"
    return token if kind == WORD else f"!{token[:3]}"


def type_features(key: str) -> tuple[list[int], list[int]]:
    """Feature ids of a type as the current token, and as a neighbour."""
    if key[:1] == "@":
        cur = ctx = ["mail"]
    elif key[:1] == "#":
        s, start = key[1:].rsplit("|", 1)
        nd = s.count("9")
        cur = [f"n={s}", f"nl={min(len(s), 20)}", f"nd={nd}", f"np={start}", "num"]
        ctx = [f"n={s}", "num", f"nd={nd}"]
    elif key[:1] == "!" or not key:
        cur = ctx = [key, "sign"]
    else:
        low = key.lower()
        form = "A" if key.isupper() and len(key) > 1 else "I" if key.isupper() else "C" if key[:1].isupper() else "a"
        cur = [f"w={low}", f"f={form}{min(len(low), 9)}", f"s3={form}{low[-3:]}", f"s4={low[-4:]}", f"s5={low[-5:]}", f"p3={form}{low[:3]}", f"p4={low[:4]}", f"f={form}"]
        ctx = [f"w={low}", f"f={form}", f"s4={form}{low[-4:]}"]
    return [bucket("c" + x) for x in cur], [bucket("x" + x) for x in ctx]


def relation(ctx: np.ndarray, where: int) -> np.ndarray:
    """Feature ids of a neighbour at distance ``where``: the neighbour's own ids moved to a slot of their own; 0 stays 0."""
    return np.where(ctx == 0, 0, (ctx * 2654435761 + where * 40503) % (BUCKETS - 1) + 1)


def stem(word: str) -> str:
    form = word.casefold()
    if not form.isascii():
        form = "".join(c for c in unicodedata.normalize("NFD", form) if not unicodedata.combining(c)).replace("’", "'")
    form = form.removesuffix("'s").removesuffix("'")
    return form[:-1] if len(form) > 4 and form.endswith("s") and not form.endswith("ss") else form


WHERE = (-1, 1, -2, 2)
SPOTS = {s: bucket(f"spot{s}") for s in range(8)}


class Types:
    """Token types met so far: interned ids, feature ids, and the cached score vectors under given weights."""

    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.ids: dict[str, int] = {"": 0}
        self.stems: dict[str, int] = {"": 0}
        self.stem_of: list[int] = [0]
        self.variants: list[tuple[int, ...]] = [()]
        self.cur: list[list[int]] = [[]]
        self.ctx: list[list[int]] = [[]]
        self.caches: list[np.ndarray] = [np.zeros((1, len(LABELS)), np.float32) for _ in range(1 + len(WHERE))]
        self.spots = np.stack([weights[SPOTS[s]] for s in range(8)])

    def id(self, key: str) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.cur)
            cur, ctx = type_features(key)
            self.cur.append(cur)
            self.ctx.append(ctx)
            self.stem_of.append(self.stem(key) if len(key) > 2 and key[0].isupper() else 0)
        return got

    def stem(self, word: str) -> int:
        """The id of a capitalised word's form without accents, case and genitive ending; similar words share forms that
        lack one letter."""
        form = stem(word)
        got = self.stems.get(form)
        if got is None:
            got = self.stems[form] = len(self.variants)
            self.variants.append(tuple({hash(form), *(hash(form[:i] + form[i + 1 :]) for i in range(len(form)))}) if len(form) >= SIMILAR_LETTERS else ())
        return got

    def features(self, since: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded feature ids of the types from ``since`` on."""
        pad = lambda rows, width: np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(-1, width)
        return pad(self.cur[since:], CUR), pad(self.ctx[since:], CTX)

    def scores(self) -> list[np.ndarray]:
        """Per slot (current, then each of WHERE) the score vectors of all types."""
        done = len(self.caches[0])
        if done < len(self.cur):
            cur, ctx = self.features(done)
            new = [self.w[cur].sum(1)] + [self.w[relation(ctx, where)].sum(1) for where in WHERE]
            self.caches = [np.concatenate([c, x]) for c, x in zip(self.caches, new)]
        return self.caches


class Chain(NamedTuple):
    """The tokens of a stretch of lines: text, kind, offset, end, spot flags (1 first, 2 last on its line, 4 no gap before)."""

    tokens: list[str]
    kinds: list[int]
    starts: list[int]
    ends: list[int]
    spots: list[int]


#: The spot of the token that stands for empty lines.
EMPTY_LINE = 7
AT_WORDS = ("at", "AT", "dot", "DOT")
AT_START, AT_END = tuple(w + " " for w in AT_WORDS), tuple(" " + w for w in AT_WORDS)


def joined(above: str, below: str) -> bool:
    """Whether a number or an address may reach from the end of one line (not blank, stripped) into the next."""
    end, start = above[-1], below[0]
    if start in "[({<" or end in "])}>":
        return True
    if start.isdigit():
        if end.isdigit() or "A" <= end <= "Z":
            return True
    elif end.isdigit() and "A" <= start <= "Z":
        return True
    return below.startswith(AT_START) or above.endswith(AT_END) or below in AT_WORDS or above in AT_WORDS


def segments(clean: str, lo: int, hi: int) -> list[tuple[int, str, bool]]:
    """(offset, text, whether an empty line comes before) of the stretches of lines that no token leaves: single lines,
    but for lines over whose end a number or an address may reach."""
    out: list[tuple[int, str, bool]] = []
    at, gap, last = lo, False, ""
    for line in clean[lo:hi].split("\n"):
        bare = line.strip()
        if bare:
            start = at + line.index(bare)
            if last and joined(last, bare):
                begin, _, before = out[-1]
                out[-1] = (begin, clean[begin : start + len(bare)], before)
            else:
                out.append((start, bare, gap))
            last, gap = bare, False
        else:
            gap = True
        at += len(line) + 1
    return out


def scanned(text: str) -> tuple[list[str], list[int], list[int], list[int], list[int]]:
    """Tokens of a segment with their kinds, starts, ends and spots."""
    found = list(BY_SIGNS[AT_SIGN.search(text) is not None, DIGIT.search(text) is not None].finditer(text))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    if "\n" not in text:
        spots = [4 if a == b else 0 for a, b in zip([0, *ends], starts)]
        if spots:
            spots[0] = 1
            spots[-1] |= 2
        return [m[0] for m in found], [m.lastindex for m in found], starts, ends, spots
    first = [1, *(1 if "\n" in text[a:b] else 0 for a, b in zip(ends, starts[1:]))]
    spots = [f | 2 * last | (4 if not f and a == b else 0) for f, last, a, b in zip(first, [*first[1:], 1], [0, *ends], starts)]
    return [m[0] for m in found], [m.lastindex for m in found], starts, ends, spots


def chain(clean: str, lo: int, hi: int) -> Chain:
    out = Chain([], [], [], [], [])
    for begin, text, gap in segments(clean, lo, hi):
        if gap and out.tokens:
            for field, value in zip(out, ("\n", SIGN, begin, begin, EMPTY_LINE)):
                field.append(value)
        tokens, kinds, starts, ends, spots = scanned(text)
        out.tokens.extend(tokens)
        out.kinds.extend(kinds)
        out.starts.extend(begin + x for x in starts)
        out.ends.extend(begin + x for x in ends)
        out.spots.extend(spots)
    return out


def stretches(clean: str, cold: set[str]) -> list[tuple[int, int]]:
    """[from, to) of the lines that may hold a value, with some context on either side, joined where they touch."""
    spots = [m.start() for m in HOT.finditer(clean)]
    if not cold.issuperset(CAPITAL.findall(clean)):
        spots += [m.start() for m in CAPITAL.finditer(clean) if m[0] not in cold]
        spots.sort()
    out: list[tuple[int, int]] = []
    upto, n = -1, len(clean)
    for at in spots:
        if at < upto:
            continue
        lo = clean.rfind("\n", 0, at) + 1
        hi = clean.find("\n", at)
        upto = hi = n if hi < 0 else hi
        before = lo
        if lo:
            before = clean.rfind("\n", 0, lo - 1) + 1
            if lo - before > CONTEXT:
                before = clean.find(" ", lo - CONTEXT, lo) + 1 or lo
        after = hi
        if hi < n:
            after = clean.find("\n", hi + 1)
            after = n if after < 0 else after
            if after - hi > CONTEXT:
                after = clean.rfind(" ", hi, hi + CONTEXT)
                after = hi if after < 0 else after
        if out and before <= out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((before, after))
    return out


# ---- labels of the sample -------------------------------------------------------------------------------------------

# Cue words of numbers issued to a person, of other numbers, and of streets.
ID_CUE = re.compile(r"(?i)(?:passport|travel document|identity|citizen|birth number|tax[ -]?(?:id|number|no)|social security|soc\.? sec|ssn|national insurance|insurance|\bNI number|ausweis|steuer|\bnif\b|\bdni\b)[^\d]{0,25}$")
# Words after which a surname is that of a place or an organisation.
NAMED_AFTER = frozenset({"bridge", "foundation", "institute", "society", "company", "hall", "street", "road", "lane", "square", "station", "school", "trust", "library", "museum", "park", "house", "works", "club", "press", "ltd", "gmbh", "inc", "brothers", "tunnel", "union"})
PHONE_SHAPE = re.compile(r"\+\d[\d ()\-.]{7,}|\(\d{3}\) \d{3}-\d{4}|0\d{4} \d{3} \d{3}|\d{3}[-.]\d{3}[-.]\d{4}|0\d{2,4} \d{4,6}-\d{2,4}")
PHONE_CUE = re.compile(r"(?i)(?:\btel\.?|phone|call|mobile|fax|new number:?|me at)\s*:?\s*$")
STREET = r"(?:[Ss]treet|[Ss]t\.|[Rr]oad|[Rr]d\.?|[Ll]ane|[Aa]ve(?:nue)?\.?|[Tt]errace|[Rr]ow|[Cc]lose|[Dd]rive|[Ss]quare|[Ww]ay|[Cc]ourt)"
PLACE = r"(?:,?\s+(?:\d{4,5}\s+[A-Z][\w-]+|[A-Z][\w-]+(?:\s+\d{4,5})?))?"
STREET_LINE = re.compile(
    rf"(?:[Ff]lat\s+\d+\w?,?\s+)?(?:\d+[A-Z]?\s+[A-Z][\w-]+\s+{STREET}(?!\w)|[Cc]alle\s+[A-Z][\w-]+\s+\d+\w?|[A-Z][\w-]*stra(?:ß|ss)e\s+\d+\w?|\d+\w?,?\s+rue\s+(?:des|de la|du|de)\s+[A-Z][\w-]+)"
    rf"(?:,\s+(?:\d{{4,5}}\s+[A-Z][\w-]+|[A-Z][\w-]+(?:\s+\d{{4,5}})?)|\n\s*(?:\d{{4,5}}\s+[A-Z][\w-]+|[A-Z][\w-]+\s+\d{{4,5}})(?=\s*(?:\n|$)))?"
)
SMALL_WORD = re.compile(r"\b[a-zà-ÿ]{3,}\b")
PLACE_WORD = re.compile(r"\b(?:in|from|at|near|for|aus|de|à|en|that)\s+([A-Z][a-z]{3,})\b(?!\s+[A-Z])")


def header_names(raw: str) -> list[list[str]]:
    """The display names in the address fields of a message, as lists of words."""
    head = messages.fields(raw.replace("\r", "").split("\n\n", 1)[0].split("\n"))
    out = []
    for field in ("from", "to", "cc", "reply-to", "sender"):
        for item in re.findall(r'("[^"]*"|[^<,"]*)<[^<>]*>', head.get(field, "")):
            shown = ENCODED.sub(_encoded, item).replace("_", " ").strip(' "')
            words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", shown)
            if words and len(words) <= 4:
                out.append(words)
    return out


def _encoded(m: re.Match) -> str:
    try:
        data = base64.b64decode(m[3]) if m[2] in "bB" else binascii.a2b_qp(m[3].replace("_", " ").encode())
        return data.decode("utf-8", "replace")
    except (ValueError, binascii.Error):
        return m[3]


def gold(clean: str, part: Chain, names: frozenset[str], common: frozenset[str] = frozenset()) -> list[int]:
    """Labels of a stretch of a sample message, by header names, shapes and cue words. ``common``: words that the sample
    also writes small or uses as places, which are never taken for unknown surnames."""
    n = len(part.tokens)
    y = [O] * n
    spans = [m.span() for m in STREET_LINE.finditer(clean, max(0, part.starts[0] if n else 0), part.ends[-1] if n else 0)]
    for i, token in enumerate(part.tokens):
        a, b = part.starts[i], part.ends[i]
        if any(lo <= a < hi for lo, hi in spans):
            y[i] = B_ADDR if any(lo == a for lo, _ in spans) or (y[i - 1] not in (B_ADDR, I_ADDR) if i else True) else I_ADDR
        elif part.kinds[i] == MAIL:
            y[i] = EMAIL
        elif part.kinds[i] == NUMERIC:
            before = " ".join(clean[max(0, a - 60) : a].split()) + " "
            if ID_CUE.search(before) and sum(c.isdigit() for c in token) >= 6:
                y[i] = ID
            elif PHONE_SHAPE.match(token) or (PHONE_CUE.search(before) and sum(c.isdigit() for c in token) >= 2 and not re.fullmatch(r"\d{1,2}[:/]\d.*", token)):
                y[i] = PHONE
    for i, token in enumerate(part.tokens):
        if y[i] == O and token[:1].isupper() and token.lower() in names and not (i + 1 < n and part.tokens[i + 1].lower() in NAMED_AFTER):
            y[i] = I_NAME
    def name_like(i: int) -> bool:
        """A capitalised word that is not written small anywhere in the sample and names no place or organisation."""
        t = part.tokens[i] if i < n else ""
        after = part.tokens[i + 1].lower() if i + 1 < n else ""
        return i < n and y[i] == O and part.kinds[i] == WORD and len(t) > 3 and t[:1].isupper() and t.lower() not in common and t.lower() not in NAMED_AFTER and after not in NAMED_AFTER

    gap = lambda i: clean[part.ends[i] : part.starts[i + 1]] if i + 1 < n else ""
    for i, token in enumerate(part.tokens):
        if len(token) == 1 and token.isupper() and i + 2 < n and part.tokens[i + 1] == "." and gap(i) == "" and (y[i + 2] == I_NAME or gap(i + 1).isspace() and name_like(i + 2)):
            y[i] = y[i + 1] = y[i + 2] = I_NAME  # an initial and a surname
        elif y[i] == I_NAME and gap(i) == " " and name_like(i + 1):
            y[i + 1] = I_NAME  # a surname that no header of the sample has
        elif y[i] == I_NAME and i >= 2 and part.tokens[i - 1] == "," and y[i - 1] == O and gap(i - 1) == " " and gap(i - 2) == "" and name_like(i - 2):
            y[i - 1] = y[i - 2] = I_NAME
        elif y[i] == I_NAME and i + 2 < n and len(part.tokens[i + 1]) == 1 and part.tokens[i + 1].isupper() and part.tokens[i + 2] == "." and gap(i).strip(" ") == "" and gap(i + 1) == "":
            y[i + 1] = y[i + 2] = I_NAME  # a middle initial
    for i in range(1, n - 1):  # Last, First
        if part.tokens[i] == "," and y[i - 1] == I_NAME and y[i + 1] == I_NAME and not part.spots[i + 1] & 1:
            y[i] = I_NAME
    for i in range(n):
        if y[i] == I_NAME and (i == 0 or y[i - 1] not in (B_NAME, I_NAME) or (part.spots[i] & 1 and part.spots[i - 1] & 2 and lone(part.spots, i - 1))):
            y[i] = B_NAME
    return y


def lone(spots, i: int) -> bool:
    """Whether the line that token i ends holds at most three tokens: a signature line, not running text."""
    j = i
    while j > 0 and not spots[j] & 1:
        j -= 1
    return i - j < 3


# ---- model ----------------------------------------------------------------------------------------------------------


def neighbours(n: int, bounds: list[tuple[int, int]], where: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that have a neighbour at distance ``where`` in their own chain, and the neighbours' positions."""
    seg = np.repeat(np.arange(len(bounds)), [hi - lo for lo, hi in bounds])
    at = np.arange(max(0, -where), n - max(0, where))
    at = at[seg[at] == seg[at + where]]
    return at, at + where


def emissions(types: Types, ids: np.ndarray, spots: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Scores of all labels for concatenated chains; neighbours do not reach over chain ends."""
    scores = types.scores()
    e = scores[0][ids] + types.spots[spots]
    for k, where in enumerate(WHERE):
        at, other = neighbours(len(ids), bounds, where)
        e[at] += scores[k + 1][ids[other]]
    return e


def marginals(e: np.ndarray, trans: np.ndarray, bounds: list[tuple[int, int]], pairs: bool = False):
    """Log marginals of all nodes (and the expected transition counts): forward and backward passes over many chains at
    once, scaled at each step."""
    out = np.empty_like(e)
    expected = np.zeros_like(trans)
    step = np.exp(trans)
    back_step, ones = np.ascontiguousarray(step.T), np.ones((e.shape[1], 1), e.dtype)
    p = np.exp(e - e.max(1, keepdims=True))
    sizes_all = np.array([hi - lo for lo, hi in bounds])
    order = np.argsort(sizes_all, kind="stable")
    lo = 0
    while lo < len(order):  # chains of like length together
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * sizes_all[order[hi]] <= CELLS:
            hi += 1
        some, sizes = order[lo:hi], sizes_all[order[lo:hi]]
        lo = hi
        starts, steps = np.array([bounds[k][0] for k in some]), int(sizes[-1])
        index = starts[None] + np.minimum(np.arange(steps)[:, None], sizes[None] - 1)
        mask = np.arange(steps)[:, None] < sizes[None]
        x = p[index]
        fwd = np.empty_like(x)
        fwd[0] = x[0] / x[0].sum(1, keepdims=True)
        first = np.searchsorted(sizes, np.arange(steps), side="right").tolist()  # chains from here on are longer than t
        for t in range(1, steps):
            k = first[t]
            nxt = (fwd[t - 1, k:] @ step) * x[t, k:]
            fwd[t, k:] = nxt / (nxt @ ones)
        bwd = np.ones_like(x)
        for t in range(steps - 2, -1, -1):
            k = first[t + 1]
            nxt = (x[t + 1, k:] * bwd[t + 1, k:]) @ back_step
            bwd[t, k:] = nxt / (nxt @ ones)
        both = (fwd * bwd)[mask]
        out[index[mask]] = np.log(both / (both @ ones) + 1e-30)
        if pairs:
            for t in range(1, steps):
                k = first[t]
                joint = fwd[t - 1, k:, :, None] * step[None] * (x[t, k:] * bwd[t, k:])[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return (out, expected) if pairs else out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


class Model(NamedTuple):
    weights: np.ndarray
    trans: np.ndarray
    skip: float = 0.0


def fit(chains: list[Chain], labels: list[list[int]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.25, decay: float = 1e-6) -> Model:
    """Weights of the chain by stochastic gradient ascent (Adagrad) on the log likelihood, in mini-batches of chains."""
    rng = np.random.default_rng(seed)
    n_labels = len(LABELS)
    w = np.zeros((BUCKETS, n_labels), np.float32)
    trans = np.zeros((n_labels, n_labels), np.float32)
    trans[:, I_NAME] -= 1
    gw, gt = np.full((BUCKETS, 1), 1e-3, np.float32), np.full_like(trans, 1e-3)
    types = Types(w)
    encoded = [np.array([types.id(type_key(t, k)) for t, k in zip(c.tokens, c.kinds)], np.int64) for c in chains]
    cur, ctx = types.features(0)
    moved = [relation(ctx, where) for where in WHERE]
    spot_ids = np.array([SPOTS[x] for x in range(8)])
    rows = []
    for c, ids in zip(chains, encoded):
        feats = np.zeros((len(ids), CUR + len(WHERE) * CTX + 1), np.int64)
        feats[:, :CUR] = cur[ids]
        for k, where in enumerate(WHERE):
            at, other = neighbours(len(ids), [(0, len(ids))], where)
            feats[at, CUR + k * CTX : CUR + (k + 1) * CTX] = moved[k][ids[other]]
        feats[:, -1] = spot_ids[c.spots]
        rows.append(feats)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), 64):
            some = [k for k in order[lo : lo + 64] if len(labels[k])]
            if not some:
                continue
            feats = np.concatenate([rows[k] for k in some])
            y = np.concatenate([labels[k] for k in some])
            ends = np.cumsum([0, *(len(labels[k]) for k in some)])
            bounds = list(zip(ends[:-1], ends[1:]))
            w[0] = 0
            e = w[feats].sum(1)
            node, expected = marginals(e, trans, bounds, pairs=True)
            grad = -np.exp(node)
            grad[np.arange(len(y)), y] += 1
            observed = np.zeros_like(trans)
            inner = np.ones(len(y), bool)
            inner[ends[:-1]] = False
            np.add.at(observed, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
            flat = feats.ravel()
            used, inverse = np.unique(flat, return_inverse=True)
            g = np.zeros((len(used), n_labels), np.float32)
            np.add.at(g, inverse, np.repeat(grad, feats.shape[1], 0).astype(np.float32))
            g -= decay * w[used] * len(y)
            gw[used] += (g * g).mean(1, keepdims=True)
            w[used] += rate * g / np.sqrt(gw[used])
            d = (observed - expected).astype(np.float32)
            gt += d * d
            trans += rate * d / np.sqrt(gt)
    w[0] = 0
    return Model(w, trans)


def word_nodes(types: Types, ids: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, word node) pairs: one node for all tokens of a message with one stem, and one for each form that similar
    stems of a message share. Nodes with one token are left out; the pairs grow with the tokens, not with their pairs."""
    stems = np.array(types.stem_of)[ids]
    nodes = np.flatnonzero(stems)
    keys = docs[nodes].astype(np.int64) << 32 | stems[nodes]
    distinct, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    # Stems of a message that share a form lacking a letter.
    own = types.variants
    forms = [own[k] for k in (distinct & 0xFFFFFFFF).tolist()]
    size = np.array([len(f) for f in forms], np.int64)
    flat = np.array([x for f in forms for x in f], np.int64)
    word = np.repeat(np.arange(len(distinct)), size)
    mixed = flat ^ ((distinct[word] >> 32) * 0x9E3779B97F4A7C1 if len(word) else 0)
    slot = (mixed & 0x3FFFFF).astype(np.int64)
    maybe = np.bincount(slot, minlength=1)[slot] > 1 if len(slot) else np.zeros(0, bool)
    shared, which, often = np.unique(mixed[maybe], return_inverse=True, return_counts=True)
    some = often[which] > 1
    link_word, link_hub = word[maybe][some], which[some]
    # Tokens by their word, so that a shared form reaches all of them.
    order = np.argsort(inverse, kind="stable")
    begin = np.concatenate([[0], np.cumsum(n)])
    counts = n[link_word]
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    by_form = order[np.repeat(begin[link_word], counts) + offset]
    often_word = n[inverse] > 1
    token = np.concatenate([nodes[often_word], nodes[by_form]])
    hub = np.concatenate([inverse[often_word], len(distinct) + np.repeat(link_hub, counts)])
    hub = np.unique(hub, return_inverse=True)[1]
    return token, hub


#: Label classes that agree over a word node: no value, name, the rest by kind.
CLASS = np.array([0, 1, 1, 2, 3, 4, 5, 5])
TO_CLASS = (CLASS[:, None] == np.arange(6)[None, :]).astype(np.float32)


class Lattice:
    """Message passing along all chains of a batch at once.

    The tokens, chain after chain, are cut into blocks of equal length that are passed over side by side. A block first
    starts from any message; blocks whose incoming message turns out different are passed over again, until none changes
    by more than SETTLED, which is the exact result whatever the cut.
    """

    def __init__(self, e: np.ndarray, trans: np.ndarray, bounds: list[tuple[int, int]]):
        n, k = e.shape
        self.n, self.rows = n, max(1, -(-n // BLOCK))
        x = np.ones((self.rows * BLOCK, k), np.float32)
        x[:n] = np.exp(e - e.max(1, keepdims=True))
        self.x = np.ascontiguousarray(x.reshape(self.rows, BLOCK, k).swapaxes(0, 1))
        step = np.exp(trans).astype(np.float32)
        self.steps = (step, np.ascontiguousarray(step.T))
        first = np.array([lo for lo, _ in bounds], np.int64)
        last = np.array([hi - 1 for _, hi in bounds], np.int64)
        self.fresh = (self._by_step(first, 0), self._by_step(last, 1))
        self.messages = [np.full_like(self.x, 1 / k) for _ in range(2)]
        self.out = [np.full((self.rows, k), 1 / k, np.float32) for _ in range(2)]
        every = np.arange(self.rows)
        for way in (0, 1):
            self._pass(way, every, False)
            self._settle(way)

    def _by_step(self, positions: np.ndarray, way: int) -> list[np.ndarray]:
        """Blocks that hold a chain's end at each step."""
        row, t = np.divmod(positions, BLOCK)
        t = t if way == 0 else BLOCK - 1 - t
        order = np.argsort(t, kind="stable")
        cuts = np.searchsorted(t[order], np.arange(BLOCK + 1))
        return [row[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]

    def _pass(self, way: int, rows: np.ndarray, stop: bool) -> None:
        """Passes over ``rows`` from their incoming message; with ``stop`` a row is left where nothing changes any more."""
        step, u, k = self.steps[way], self.messages[way], self.x.shape[2]
        whole = len(rows) == self.rows
        at = 0 if way == 0 else BLOCK - 1
        v = u[at] if whole else u[at, rows]
        ones = np.ones((k, 1), np.float32)
        where = np.full(self.rows, -1)
        for t in range(BLOCK):
            at = t if way == 0 else BLOCK - 1 - t
            nxt = (v * (self.x[at] if whole else self.x[at, rows])) @ step
            nxt /= nxt @ ones
            if t + 1 == BLOCK:
                self.out[way][rows] = nxt
                return
            fresh = self.fresh[way][t + 1]
            if len(fresh):
                if whole:
                    nxt[fresh] = 1 / k
                else:
                    where[rows] = np.arange(len(rows))
                    hit = where[fresh]
                    nxt[hit[hit >= 0]] = 1 / k
                    where[rows] = -1
            to = at + 1 if way == 0 else at - 1
            if stop:
                moved = np.abs(nxt - u[to, rows]).max(1) > SETTLED
                rows, nxt, whole = rows[moved], nxt[moved], False
                if not len(rows):
                    return
            if whole:
                u[to] = nxt
            else:
                u[to, rows] = nxt
            v = nxt

    def _settle(self, way: int) -> None:
        k = self.x.shape[2]
        while True:
            new = np.full((self.rows, k), 1 / k, np.float32)
            if way == 0:
                new[1:] = self.out[0][:-1]
            else:
                new[:-1] = self.out[1][1:]
            new[self.fresh[way][0]] = 1 / k
            at = 0 if way == 0 else BLOCK - 1
            rows = np.flatnonzero(np.abs(new - self.messages[way][at]).max(1) > SETTLED)
            if not len(rows):
                return
            self.messages[way][at, rows] = new[rows]
            self._pass(way, rows, True)

    def belief(self, nodes: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the labels of ``nodes``."""
        if nodes is None:
            p = (self.messages[0] * self.x * self.messages[1]).swapaxes(0, 1).reshape(-1, self.x.shape[2])[: self.n]
        else:
            row, t = np.divmod(nodes, BLOCK)
            p = self.messages[0][t, row] * self.x[t, row] * self.messages[1][t, row]
        return p / np.maximum(p.sum(1, keepdims=True), 1e-37)

    def set(self, nodes: np.ndarray, e: np.ndarray) -> None:
        """New scores of ``nodes``; the messages of their blocks, and of all that this changes, are passed again."""
        row, t = np.divmod(nodes, BLOCK)
        self.x[t, row] = np.exp(e - e.max(1, keepdims=True))
        rows = np.unique(row)
        for way in (0, 1):
            self._pass(way, rows, False)
            self._settle(way)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def settled(e: np.ndarray, trans: np.ndarray, bounds: list[tuple[int, int]], token: np.ndarray, hub: np.ndarray, skip: float) -> Lattice:
    """Message passing along the chains and over the word nodes, until no belief changes by more than MOVED."""
    lattice = Lattice(e, trans, bounds)
    if not len(token) or not skip:
        return lattice
    nodes, own = np.unique(token, return_inverse=True)
    bond = np.float32(np.expm1(skip)) * np.eye(6, dtype=np.float32) + 1
    n_hubs = int(hub.max()) + 1
    sent = np.zeros((len(token), 6), np.float32)  # from the word node to the token
    for _ in range(MOST_ROUNDS):
        p = np.log(lattice.belief(nodes) @ TO_CLASS + 1e-30)
        up = np.log(np.exp(_log_softmax(p[own] - sent)) @ bond)
        up -= up.max(1, keepdims=True)
        total = np.stack([np.bincount(hub, up[:, c], n_hubs) for c in range(6)], 1).astype(np.float32)
        down = np.log(np.exp(_log_softmax(total[hub] - up)) @ bond)
        down -= down.max(1, keepdims=True)
        change = np.zeros_like(p)
        np.add.at(change, own, down - sent)
        moved = np.abs(np.exp(_log_softmax(p + change)) - np.exp(p)).max(1) > MOVED
        if not moved.any():
            break
        mine = moved[own]
        sent[mine] = down[mine]
        into = np.zeros((len(nodes), 6), np.float32)
        np.add.at(into, own, sent)
        some = nodes[moved]
        lattice.set(some, e[some] + into[moved][:, CLASS])
    return lattice


def decode(model: Model, types: Types, ids: np.ndarray, spots: np.ndarray, bounds: list[tuple[int, int]], token: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """The most likely label of every token."""
    return settled(emissions(types, ids, spots, bounds), model.trans, bounds, token, hub, model.skip).belief().argmax(1)


def agreement(model: Model, chains: list[Chain], labels: list[list[int]], docs: list[int]) -> float:
    """The weight of agreement over word nodes under which labelled chains that ``model`` has not seen are most likely, by
    the beliefs that message passing settles on."""
    if not chains:
        return 0.0
    types = Types(model.weights)
    ids = np.array([types.id(type_key(t, k)) for c in chains for t, k in zip(c.tokens, c.kinds)], np.int64)
    spots = np.array([x for c in chains for x in c.spots], np.int64)
    ends = np.cumsum([0, *(len(c.tokens) for c in chains)])
    bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
    token, hub = word_nodes(types, ids, np.repeat(np.array(docs), np.diff(ends)))
    y = np.concatenate([np.array(x) for x in labels])
    e = emissions(types, ids, spots, bounds)
    at = np.arange(len(y))
    likely = [np.log(settled(e, model.trans, bounds, token, hub, w).belief()[at, y] + 1e-6).sum() for w in SKIP_WEIGHTS]
    return SKIP_WEIGHTS[int(np.argmax(likely))]


class Entity(NamedTuple):
    body: int
    start: int
    end: int
    kind: str


def entities(starts, ends, spots, y, clean: str, body: int) -> list[Entity]:
    """Runs of labels as values. A run of a kind ends where a new one begins, or at a signature line's end (names)."""
    out: list[Entity] = []
    n, upto = len(y), 0
    for i in np.flatnonzero(np.asarray(y)).tolist():
        if i < upto:
            continue
        kind = KIND[y[i]]
        j = i + 1
        while j < n and KIND[y[j]] == kind:
            if y[j] in (B_NAME, B_ADDR) or (kind == "email") or (kind == "name" and spots[j] & 1 and lone(spots, j - 1)):
                break
            j += 1
        upto = j
        a, b = i, j - 1
        text = lambda t: clean[starts[t] : ends[t]]
        while a <= b and not any(c.isalnum() for c in text(a)) and text(a)[:1] not in ("(", "+"):
            a += 1
        while b >= a and not any(c.isalnum() for c in text(b)):
            b -= 1
        # A street told to go on without having begun begins with the number right before it.
        if a <= b and kind == "address" and y[i] == I_ADDR and a > 0 and not y[a - 1] and (a < 2 or KIND[y[a - 2]] != "address") and text(a - 1)[:1].isdigit() and clean[ends[a - 1] : starts[a]].isspace() and not any(c.isdigit() for c in clean[starts[a] : ends[b]]):
            a -= 1
        if a <= b and (kind != "address" or any(c.isdigit() for c in clean[starts[a] : ends[b]])):
            out.append(Entity(body, int(starts[a]), int(ends[b]), kind))
    return out


class Finder:
    """Finds values in batches of messages; keeps token types, and lines as tokens, between batches."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.types = Types(self.model.weights)
        self.lines: dict[str, np.ndarray] = {}
        self.gap = np.array([[self.types.id(type_key("\n", SIGN))], [EMPTY_LINE], [0], [0]])

    def line(self, text: str) -> np.ndarray:
        """(type, spot, start, end) of the tokens of a segment."""
        tokens, kinds, starts, ends, spots = scanned(text)
        type_id, known = self.types.id, self.types.ids.get
        got = np.array([[(known(t) or type_id(t)) if g == WORD else type_id(type_key(t, g)) for t, g in zip(tokens, kinds)], spots, starts, ends])
        if len(self.lines) < REMEMBERED and len(text) <= 200:
            self.lines[text] = got
        return got

    def find(self, raws: list[str | None], encoded: bool = True) -> list[tuple[list[Body], list[Entity]]]:
        found: list[tuple[list[Body], list[Entity]]] = []
        if len(self.types.cur) > TYPES or len(self.lines) >= REMEMBERED:  # bounded memory
            self._forget()
        rows: list[np.ndarray] = []
        offsets: list[int] = []
        bounds: list[tuple[int, int]] = []
        where: list[tuple[int, int]] = []
        n = 0
        known, line = self.lines.get, self.line
        for d, raw in enumerate(raws):
            own = bodies(raw, encoded)
            found.append((own, []))
            for k, body in enumerate(own):
                lo = n
                for begin, text, gap in segments(body.clean, 0, len(body.clean)):
                    if gap and n > lo:
                        rows.append(self.gap)
                        offsets.append(begin)
                        n += 1
                    got = known(text)
                    if got is None:
                        got = line(text)
                    rows.append(got)
                    offsets.append(begin)
                    n += got.shape[1]
                if n > lo:
                    bounds.append((lo, n))
                    where.append((d, k))
        if bounds:
            ids, spots, starts, ends = np.concatenate(rows, 1)
            shift = np.repeat(offsets, [r.shape[1] for r in rows])
            docs = np.repeat([d for d, _ in where], [hi - lo for lo, hi in bounds])
            y = decode(self.model, self.types, ids, spots, bounds, *word_nodes(self.types, ids, docs))
            starts, ends = starts + shift, ends + shift
            for (lo, hi), (d, k) in zip(bounds, where):
                if y[lo:hi].any():
                    found[d][1].extend(entities(starts[lo:hi], ends[lo:hi], spots[lo:hi], y[lo:hi], found[d][0][k].clean, k))
        return found


def sample(docs: DataFrame, size: int = SAMPLE_DOCS) -> list[str]:
    """A bounded sample of messages, by the least hashes of their ids."""
    picked = docs.where("text IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).collect()
    return [r.text for r in rows]


def train(raws: list[str], epochs: int = EPOCHS) -> Model:
    """A model fitted on sample messages: their header names and the shapes of values are the labels."""
    names = frozenset(w.lower() for raw in raws for words in header_names(raw) for w in words if len(w) > 2)
    whole = [bodies(raw) for raw in raws]
    common = frozenset(w for own in whole for b in own for w in SMALL_WORD.findall(b.clean)) | frozenset(w.lower() for own in whole for b in own for w in PLACE_WORD.findall(b.clean))
    chains, labels, docs = [], [], []
    for k, own in enumerate(whole):
        for body in own:
            plain = {t for t in CAPITAL.findall(body.clean) if t.lower() not in names and zlib.crc32(f"{k}{t}".encode()) % PLAIN_LINES}
            for lo, hi in stretches(body.clean, plain):
                part = chain(body.clean, lo, hi)
                if part.tokens:
                    chains.append(part)
                    labels.append(gold(body.clean, part, names, common))
                    docs.append(k)
    held = [d < len(raws) * HELD for d in docs]
    pick = lambda x, side: [v for v, h in zip(x, held) if h == side]
    unseen = fit(pick(chains, False), pick(labels, False), HELD_EPOCHS)
    return fit(chains, labels, epochs)._replace(skip=agreement(unseen, pick(chains, True), pick(labels, True), pick(docs, True)))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("value", pa.string())])


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line_no, kind, value) of every value in parts that are not base64; line_no counts raw lines from 0.

    Null and empty texts, and messages without a body, give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), BATCH_DOCS):
                flat = []
                for key, (own, values) in zip(keys[lo : lo + BATCH_DOCS], finder.find(texts[lo : lo + BATCH_DOCS], False)):
                    for v in values:
                        line = own[v.body].raw_line(v.start)
                        if line >= 0:
                            flat.append((key, line, v.kind, own[v.body].clean[v.start : v.end]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ([],) * 4, SCHEMA.types)], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, line_no int, kind string, value string")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind): the raw lines on which a personal value begins."""
    return spans(docs, train(sample(docs))).select("doc_id", "line_no", "kind").distinct()


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_values): the decoded body with every value as a placeholder of its kind. Every message once."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_values", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), BATCH_DOCS):
                flat = []
                for key, (own, values) in zip(keys[lo : lo + BATCH_DOCS], finder.find(texts[lo : lo + BATCH_DOCS])):
                    done = []
                    for k, body in enumerate(own):
                        at, out = 0, []
                        for v in sorted((v for v in values if v.body == k), key=lambda v: v.start):
                            if v.start >= at:
                                out += [body.text[at : v.start], PLACEHOLDER[v.kind]]
                                at = v.end
                        done.append("".join(out) + body.text[at:])
                    flat.append((key, "\n".join(done), len(values)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat) if flat else ([],) * 3, schema.types)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, n_values int").dropDuplicates(["doc_id"])
