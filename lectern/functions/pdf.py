"""Text of PDF files: the strings that each page shows, in the order of the file's page tree.

Reads files with plain or deflated streams and with objects in the clear or in object streams, and shows strings in one-byte
or UTF-16 encoding.  Fonts that renumber their glyphs come out as their numbers say, and encrypted files raise.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_KIDS, _CONTENTS = (re.compile(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % name) for name in (b"Kids", b"Contents"))
_TITLE = re.compile(rb"/Title\s*(\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]*>)", re.S)
_SHOWN = re.compile(
    rb"(?P<text>\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)|(?P<gap>-\d{3,}(?:\.\d+)?)|(?P<line>(?<![\w*])(?:T\*|Td|TD|Tm|'|\"|ET)(?![\w*]))|(?P<array>[\[\]])", re.S
)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body and (inner := _content(body)):
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
            heads = list(map(int, inner[:first].split()))[: 2 * n]
            ends = [*heads[3::2], len(inner) - first]
            for number, start, end in zip(heads[::2], heads[1::2], ends):
                found.setdefault(number, inner[first + start : first + end])
    return found


def _content(body: bytes) -> bytes:
    """The data of a stream object; empty for other objects."""
    m = _STREAM.match(body)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]


def _shown(content: bytes) -> str:
    """The lines of a content stream: strings in a row, a space where they are set far apart, a new line where the text moves."""
    out, in_array = [], False
    for m in _SHOWN.finditer(content):
        if m["text"]:
            out.append(_string(m["text"]))
        elif m["array"]:
            in_array = m["array"] == b"["
        elif m["gap"]:
            if in_array:
                out.append(" ")
        else:
            out.append("\n")
    return "\n".join(line for raw in "".join(out).split("\n") if (line := raw.strip()))


def pages(data: bytes) -> tuple[str | None, list[str]]:
    """(title, the text of each page) of a file."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if b"/Encrypt" in data:
        raise ValueError("an encrypted PDF file")
    objects = _objects(data)
    kids = {n: [int(k) for k in _REFERENCE.findall(m[1])] for n, body in objects.items() if (m := _KIDS.search(body))}
    below = {k for ks in kids.values() for k in ks}
    order, stack, seen = [], [n for n in sorted(kids, reverse=True) if n not in below], set()
    while stack:
        n = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in kids:
            stack.extend(reversed(kids[n]))
        elif n in objects:
            order.append(n)
    texts = []
    for n in order:
        m = _CONTENTS.search(objects[n])
        parts = [_content(objects.get(int(k), b"")) for k in _REFERENCE.findall(m[1])] if m else []
        texts.append(_shown(b"\n".join(parts)))
    named = next((m for body in objects.values() if (m := _TITLE.search(body))), None)
    return (_string(named[1]).strip() or None) if named else None, texts


def marked_text(data: bytes) -> tuple[str | None, str, int]:
    """(title, text with a [PDF_PAGE n] line before each page that has text, number of pages)."""
    title, texts = pages(data)
    parts = [f"\n[PDF_PAGE {n}]\n{text}" for n, text in enumerate(texts, 1) if text]
    return title, "\n".join(parts).strip(), len(texts)
