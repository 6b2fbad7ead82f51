"""Text of Markdown and PDF files."""

from __future__ import annotations

import re
import zlib

from lorekeep.errors import ExtractError


def extract(data: bytes, kind: str) -> str:
    """The text of a file of a format; ExtractError where it is malformed."""
    return pdf_text(data) if kind == "pdf" else markdown_text(data)


def markdown_text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ExtractError(f"not UTF-8: {e.reason} at byte {e.start}") from e


def pdf_text(data: bytes) -> str:
    """Text shown by a PDF's content streams, in file order: plain and Flate streams, literal and hex strings.

    Fonts are taken to be in a Latin encoding or UTF-16; a PDF without text gives an empty string.
    """
    if not data.lstrip()[:5].startswith(b"%PDF-") or b"%%EOF" not in data[-2048:]:
        raise ExtractError("not a PDF")
    out = []
    for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        head, body = m[1], m[2]
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error as e:
                raise ExtractError(f"a stream does not inflate: {e}") from e
        elif b"/Filter" in head:
            continue
        if re.search(rb"\bBT\b", body):
            out.append(_shown(body))
    return "\n".join(t for t in out if t)


_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("cp1252", "replace")


def _shown(body: bytes) -> str:
    text, strings, inside = [], [], False
    for m in _TOKEN.finditer(body):
        token = m[0]
        if token[:1] in b"(<":
            strings.append(_string(token))
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            text.append(("\n" if token in (b"'", b'"') else "") + "".join(strings))
            strings = []
        elif token in (b"Td", b"TD", b"T*", b"ET"):
            text.append("\n")
            strings = []
        elif inside and re.fullmatch(rb"-?\d+(\.\d+)?", token) and float(token) < -200:
            strings.append(" ")
        inside = token == b"[" or inside and token != b"]"
    return re.sub(r"\n+", "\n", "".join(text)).strip("\n")
