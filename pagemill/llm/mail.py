"""Raw messages as a reader sees them, with every shown line tied to its raw line.

A message is header lines, an empty line and a body; a body may be one text or a tree of parts. Transfer encodings are
undone line by line, so that a damaged stretch spoils no more than itself; missing last boundaries, damaged base64 and
unknown character sets are tolerated.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re
from typing import NamedTuple

HEADER = re.compile(r"^([!-9;-~]+):[ \t]*(.*)$")
BOUNDARY = re.compile(r'boundary="?([^";\s]+)"?', re.I)
NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
BREAK_TAG = re.compile(r"<(?:/?(?:p|div|tr|li|ul|ol|table|h[1-6]|blockquote|body|html|head|title|td|th|pre|hr)\b[^<>]*|br\s*/?)>", re.I)
HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
REPLY_MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+")


class Line(NamedTuple):
    """A shown line, and where its stretches begin: (offset, raw line number)."""

    text: str
    origin: tuple[tuple[int, int], ...]


class Part(NamedTuple):
    kind: str  # plain or html
    encoding: str  # "", quoted-printable or base64
    lines: list[Line]
    raw_lines: tuple[int, list[str]] = (0, [])  # of base64: the first raw line's number, and the lines


def fields(lines: list[str]) -> dict[str, str]:
    """Header fields, unfolded, by lower-cased name; the first of each name counts."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif m := HEADER.match(line):
            name = m[1].lower()
            if name in out:
                name += "#"  # a repeated field is read past
            out[name] = m[2]
    return out


def _text(raw: bytes | bytearray) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def undo_quoted(lines: list[str], first: int) -> list[Line]:
    """Quoted-printable lines with soft breaks joined; characters cut by a soft break come out whole."""
    out: list[Line] = []
    raw, stretches = bytearray(), []
    for i, line in enumerate(lines):
        line = line.rstrip(" \t")
        soft = line.endswith("=")
        stretches.append((len(raw), first + i))
        raw += binascii.a2b_qp((line[:-1] if soft else line).encode("utf-8", "replace"))
        if not soft or i + 1 == len(lines):
            if len(stretches) == 1:
                out.append(Line(_text(raw), ((0, stretches[0][1]),)))
            else:
                out.append(Line(_text(raw), tuple((len(raw[:b].decode("utf-8", "ignore")), n) for b, n in stretches)))
            raw, stretches = bytearray(), []
    return out


def base64_line(line: str) -> bytes:
    """The bytes of one line; signs outside the alphabet are skipped, and a damaged line gives none."""
    bare = NOT_BASE64.sub("", line)
    bare = bare[: len(bare) - 1] if len(bare) % 4 == 1 else bare
    try:
        return binascii.a2b_base64(bare + "=" * (-len(bare) % 4))
    except binascii.Error:
        return b""


def undo_base64(lines: list[str]) -> str:
    """Base64 lines as text; a damaged line loses at most itself."""
    return b"".join(map(base64_line, lines)).decode("utf-8", "replace")


def _part(head: dict[str, str], body: list[str], first: int) -> Part | None:
    kind = head.get("content-type", "text/plain").lower().lstrip()
    if not kind.startswith("text/") and kind.split(";")[0].strip() not in ("", "text"):
        return None
    shape = "html" if kind.startswith("text/html") else "plain"
    encoding = head.get("content-transfer-encoding", "").strip().lower()
    if encoding == "base64":
        return Part(shape, encoding, [Line(x, ()) for x in undo_base64(body).split("\n")], (first, body))
    if encoding == "quoted-printable":
        return Part(shape, encoding, undo_quoted(body, first))
    return Part(shape, encoding, [Line(x, ((0, first + i),)) for i, x in enumerate(body)])


def parts(raw: str | None) -> list[Part]:
    """The text parts of a message in order. Null or empty: none. A message without empty line has no body."""
    if not raw:
        return []
    lines = raw.split("\n")
    if "\r" in raw:
        lines = [x[:-1] if x.endswith("\r") else x for x in lines]
    try:
        blank = lines.index("")
    except ValueError:
        return []
    head = fields(lines[:blank])
    kind = head.get("content-type", "")
    if "multipart" not in kind.lower():
        one = _part(head, lines[blank + 1 :], blank + 1)
        return [one] if one else []
    known = set(BOUNDARY.findall(kind))
    out: list[Part] = []
    state, start, own = "preamble", blank + 1, {}
    n = len(lines)
    for i in range(blank + 1, n + 1):
        line = lines[i] if i < n else None
        mark = line is None or (line.startswith("--") and (line[2:] in known or line[2:-2] in known or (i + 1 < n and lines[i + 1][:8].lower() == "content-" and " " not in line.strip())))
        if mark:
            if state == "body" and (p := _part(own, lines[start:i], start)):
                out.append(p)
            closing = line is not None and line.endswith("--") and line[2:-2] in known
            state, start, own = ("between" if closing else "head"), i + 1, {}
        elif state == "head" and line == "":
            own = fields(lines[start:i])
            inner = own.get("content-type", "")
            if "multipart" in inner.lower():
                known.update(BOUNDARY.findall(inner))
                state = "between"
            else:
                state, start = "body", i + 1
    return out


def strip_markup(text: str) -> str:
    """HTML as the text it shows."""
    text = HIDDEN.sub(" ", text) if "<!--" in text or "<s" in text or "<S" in text else text
    return html.unescape(TAG.sub("", BREAK_TAG.sub("\n", text)))


def shown(raw: str | None) -> str:
    """The text of all text parts and text attachments, encodings and markup undone, reply marks dropped."""
    out: list[str] = []
    for part in parts(raw):
        lines = [x.text for x in part.lines]
        if part.kind == "html":
            lines = strip_markup("\n".join(lines)).split("\n")
        out += [REPLY_MARK.sub("", x) if ">" in x else x for x in lines]
    return "\n".join(out)


CHARACTER = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
MARKED_LINE = re.compile(REPLY_MARK.pattern, re.M)


class Traced(NamedTuple):
    """A shown text and, a character, the raw text's range it comes from: the character itself where the part has no
    transfer encoding, else its raw line."""

    text: str
    starts: list[int]
    ends: list[int]

    def replaced(self, pattern: re.Pattern, new) -> Traced:
        out, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            put = new(m)
            out += [self.text[at : m.start()], put]
            starts += self.starts[at : m.start()] + [self.starts[m.start()]] * len(put)
            ends += self.ends[at : m.start()] + [self.ends[m.end() - 1]] * len(put)
            at = m.end()
        return Traced("".join([*out, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])


def traced(raw: str | None) -> Traced:
    """:func:`shown` with the way back to the raw text, for messages in which something was found."""
    begins, at = [], 0
    for line in (raw or "").split("\n"):
        begins.append((at, at + len(line)))
        at += len(line) + 1
    whole = Traced("", [], [])
    for i, part in enumerate(parts(raw)):
        text, starts, ends = [], [], []

        def add(chunk: str, n: int, exact: int | None = None) -> None:
            a, b = begins[n]
            text.append(chunk)
            starts.extend(range(a + exact, a + exact + len(chunk)) if exact is not None else [a] * len(chunk))
            ends.extend(range(a + exact + 1, a + exact + len(chunk) + 1) if exact is not None else [b] * len(chunk))

        if part.encoding == "base64":
            first, body = part.raw_lines
            decoder = codecs.getincrementaldecoder("utf-8")("replace")
            for k, line in enumerate(body):
                add(decoder.decode(base64_line(line), k + 1 == len(body)), first + k)
        else:
            for k, line in enumerate(part.lines):
                if k:
                    add("\n", line.origin[0][1])
                cuts = [o for o, _ in line.origin[1:]] + [len(line.text)]
                for (offset, n), upto in zip(line.origin, cuts):
                    add(line.text[offset:upto], n, offset if part.encoding != "quoted-printable" else None)
        one = Traced("".join(text), starts, ends)
        if part.kind == "html":
            if "<!--" in one.text or "<s" in one.text or "<S" in one.text:
                one = one.replaced(HIDDEN, lambda m: " ")
            one = one.replaced(BREAK_TAG, lambda m: "\n").replaced(TAG, lambda m: "").replaced(CHARACTER, lambda m: html.unescape(m[0]))
        one = one.replaced(MARKED_LINE, lambda m: "")
        if i:
            edge = whole.ends[-1] if whole.ends else 0
            whole = Traced(whole.text + "\n", [*whole.starts, edge], [*whole.ends, edge])
        whole = Traced(whole.text + one.text, whole.starts + one.starts, whole.ends + one.ends)
    return whole
