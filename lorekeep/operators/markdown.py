"""Heading-aware Markdown chunks that map back to bytes of the source.

A block parser (CommonMark's blocks: headings, paragraphs, lists, quotes, code, HTML, rules, link definitions,
YAML front matter) gives the leaves that hold text. Each character of a leaf knows the bytes it came from, so
joining, trimming and splitting keep ranges exact.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.chunking import OVERLAP_CHARS, WINDOW_CHARS

SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ATX = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
QUOTE = re.compile(r" {0,3}> ?")
#: The tags that open an HTML block by themselves.
HTML_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
ATTRIBUTES = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*"
TAG = rf"<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTES}\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
HTML_START = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(HTML_TAGS)})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf" {{0,3}}(?:{TAG})\s*$"), None),
]
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*(?:\n[ \t]*)?(?<=[ \t\n])(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?)>")
RAW_HTML = re.compile(rf"{TAG}|<!---->|<!--(?!-?>)(?:(?!--).)*-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
TARGET = re.compile(r"\(\s*(?:(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()<\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?)?\s*\)", re.S)
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Mapped:
    """Text whose characters know their bytes in the source: (start, end), or None for what was put in."""

    text: str = ""
    spans: list[tuple[int, int] | None] = field(default_factory=list)

    def add(self, text: str, spans: list[tuple[int, int] | None]) -> None:
        self.text += text
        self.spans += spans

    def join(self, other: Mapped) -> None:
        self.add("\n\n", [None, None])
        self.add(other.text, other.spans)

    def part(self, a: int, b: int) -> Mapped:
        return Mapped(self.text[a:b], self.spans[a:b])

    def trimmed(self) -> Mapped:
        a = len(self.text) - len(self.text.lstrip(SPACES))
        return self.part(a, max(a, len(self.text.rstrip(SPACES))))

    def start(self, at: int = 0) -> int | None:
        return next((s[0] for s in self.spans[at:] if s), None)

    def end(self) -> int | None:
        return max((s[1] for s in self.spans if s), default=None)


@dataclass
class Line:
    """A line below the containers that were taken off: its characters' offsets in the document."""

    text: str
    at: list[int]

    def cut(self, n: int) -> Line:
        return Line(self.text[n:], self.at[n:])

    def start(self, end: int) -> int:
        return self.at[0] if self.at else end


@dataclass
class Leaf:
    kind: str  # heading, paragraph, code, html, rule, metadata
    start: int
    lines: list[Line]


@dataclass
class Container:
    kind: str  # document, quote, list, item
    start: int
    children: list[Container | Leaf] = field(default_factory=list)


def _indent(text: str) -> int:
    width = 0
    for c in text:
        if c == " ":
            width += 1
        elif c == "\t":
            width += 4 - width % 4
        else:
            break
    return width


def _dedent(line: Line, columns: int) -> Line:
    """Without so many columns of white space; a tab that is cut leaves its rest as spaces."""
    width = k = 0
    while k < len(line.text) and width < columns and line.text[k] in " \t":
        width += 1 if line.text[k] == " " else 4 - width % 4
        k += 1
    rest = line.cut(k)
    if width > columns:
        rest = Line(" " * (width - columns) + rest.text, [line.at[k - 1]] * (width - columns) + rest.at)
    return rest


class Blocks:
    """Parses lines into containers and leaves."""

    def __init__(self) -> None:
        self.labels: set[str] = set()

    def parse(self, lines: list[Line], into: Container, end: int) -> None:
        k = 0
        while k < len(lines):
            line = lines[k]
            if not line.text.strip(" \t"):
                k += 1
            elif _indent(line.text) >= 4:
                k = self._indented(lines, k, into, end)
            elif RULE.match(line.text):
                into.children.append(Leaf("rule", line.start(end), [line]))
                k += 1
            elif m := ATX.match(line.text):
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", line.text[m.end() :])
                into.children.append(Leaf("heading", line.at[m.start(1)], [Line(body, line.at[m.end() : m.end() + len(body)])]))
                k += 1
            elif m := FENCE.match(line.text):
                k = self._fenced(lines, k, m, into, end)
            elif QUOTE.match(line.text):
                k = self._quote(lines, k, into, end)
            elif m := ITEM.match(line.text):
                k = self._list(lines, k, into, end)
            elif kind := next((x for x in HTML_START if x[0].match(line.text)), None):
                k = self._html(lines, k, kind, into, end)
            else:
                k = self._paragraph(lines, k, into, end)

    def _indented(self, lines: list[Line], k: int, into: Container, end: int) -> int:
        first, held = k, []
        while k < len(lines) and (_indent(lines[k].text) >= 4 or not lines[k].text.strip(" \t")):
            held.append(_dedent(lines[k], 4))
            k += 1
        while held and not held[-1].text.strip():
            held.pop()
        into.children.append(Leaf("code", held[0].start(end) if held else lines[first].start(end), held))
        return k

    def _fenced(self, lines: list[Line], k: int, m: re.Match[str], into: Container, end: int) -> int:
        first, mark = lines[k], m[1]
        close = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        pad, held = _indent(first.text), []
        k += 1
        while k < len(lines) and not close.match(lines[k].text):
            held.append(_dedent(lines[k], pad))
            k += 1
        into.children.append(Leaf("code", first.at[m.start(1)], held))
        return k + 1

    def _html(self, lines: list[Line], k: int, kind: tuple, into: Container, end: int) -> int:
        first, held = lines[k], []
        while k < len(lines):
            if kind[1] is None and not lines[k].text.strip():
                break
            held.append(lines[k])
            k += 1
            if kind[1] is not None and kind[1].search(held[-1].text):
                break
        into.children.append(Leaf("html", first.start(end), held))
        return k

    def _interrupts(self, text: str) -> bool:
        """Whether a line ends a paragraph (a list only by a bullet or 1, with text)."""
        if _indent(text) >= 4:
            return False
        item = ITEM.match(text)
        starts_list = item and text[item.end() :].strip() and (not item[2][0].isdigit() or int(item[2][:-1]) == 1)
        return bool(RULE.match(text) or ATX.match(text) or FENCE.match(text) or QUOTE.match(text) or starts_list or any(x[0].match(text) for x in HTML_START[:6]))

    def _lazy(self, text: str, inner: list[Line]) -> bool:
        """Whether a line without its container's mark goes on with an open paragraph in it."""
        if not text.strip() or self._interrupts(text) or ITEM.match(text) and _indent(text) < 4:
            return False
        return self._open_paragraph(inner)

    def _open_paragraph(self, inner: list[Line]) -> bool:
        if not inner or not inner[-1].text.strip():
            return False
        trial = Container("document", 0)
        Blocks().parse(inner, trial, 0)
        node: Container | Leaf | None = trial
        while isinstance(node, Container):
            node = node.children[-1] if node.children else None
        return node is not None and node.kind == "paragraph"

    def _quote(self, lines: list[Line], k: int, into: Container, end: int) -> int:
        quote = Container("quote", lines[k].at[len(lines[k].text) - len(lines[k].text.lstrip(" "))])
        inner: list[Line] = []
        while k < len(lines):
            if _indent(lines[k].text) < 4 and (m := QUOTE.match(lines[k].text)):
                inner.append(lines[k].cut(m.end()))
            elif self._lazy(lines[k].text, inner):
                inner.append(Line(lines[k].text.lstrip(" \t"), lines[k].at[len(lines[k].text) - len(lines[k].text.lstrip(" \t")) :]))
            else:
                break
            k += 1
        self.parse(inner, quote, end)
        into.children.append(quote)
        return k

    def _list(self, lines: list[Line], k: int, into: Container, end: int) -> int:
        first = ITEM.match(lines[k].text)
        mark = first[2][-1] if first[2][-1] in ".)" else first[2]
        found = Container("list", lines[k].at[first.start(2)])
        while k < len(lines):
            text = lines[k].text
            m = ITEM.match(text) if _indent(text) < 4 else None
            if not m or (m[2][-1] if m[2][-1] in ".)" else m[2]) != mark or RULE.match(text):
                break
            item = Container("item", lines[k].at[m.start(2)])
            after = text[m.end() :]
            gap = _indent(after)
            blank = not after.strip(" \t")
            width = m.end() + (1 if blank or gap > 4 else gap)
            inner = [_dedent(lines[k].cut(m.end()), 1 if gap > 4 else gap)]
            k += 1
            if blank and (k >= len(lines) or not lines[k].text.strip()):
                self.parse(inner, item, end)
                found.children.append(item)
                while k < len(lines) and not lines[k].text.strip():
                    k += 1
                continue
            while k < len(lines):
                text = lines[k].text
                if not text.strip():
                    ahead = k
                    while ahead < len(lines) and not lines[ahead].text.strip():
                        ahead += 1
                    if ahead < len(lines) and _indent(lines[ahead].text) >= width:
                        inner += [Line("", []) for _ in range(ahead - k)]
                        k = ahead
                        continue
                    break
                if _indent(text) >= width:
                    inner.append(_dedent(lines[k], width))
                elif self._lazy(text, inner):
                    inner.append(Line(text.lstrip(" \t"), lines[k].at[len(text) - len(text.lstrip(" \t")) :]))
                else:
                    break
                k += 1
            self.parse(inner, item, end)
            found.children.append(item)
            ahead = k
            while ahead < len(lines) and not lines[ahead].text.strip():
                ahead += 1
            if ahead < len(lines) and ITEM.match(lines[ahead].text) and _indent(lines[ahead].text) < 4:
                k = ahead
        into.children.append(found)
        return k

    def _paragraph(self, lines: list[Line], k: int, into: Container, end: int) -> int:
        held = []
        kind = "paragraph"
        while k < len(lines) and lines[k].text.strip():
            text = lines[k].text
            if held and _indent(text) < 4 and SETEXT.match(text):
                kind = "heading"
                k += 1
                break
            if held and self._interrupts(text):
                break
            lead = len(text) - len(text.lstrip(" \t"))
            held.append(lines[k].cut(lead))
            k += 1
        start = held[0].start(end)
        while m := DEFINITION.match("\n".join(x.text for x in held)):
            self.labels.add(_label(m[1]))
            held = held[m[0].rstrip("\n").count("\n") + 1 :]
            if not held:
                break
        if held:
            into.children.append(Leaf(kind, start if kind == "heading" else held[0].start(end), held))
        return k


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


class Inline:
    """Plain text of a paragraph or heading, with the bytes of each character."""

    def __init__(self, leaf: Leaf, bytes_at: list[int], labels: set[str]):
        self.source, self.at = "", []
        for n, line in enumerate(leaf.lines):
            if n:
                self.source += "\n"
                self.at.append(self.at[-1] + 1 if self.at else leaf.start)
            self.source += line.text
            self.at += line.at
        stop = len(self.source.rstrip(" \t\n"))
        self.source, self.at = self.source[:stop], self.at[:stop]
        self.bytes_at, self.labels = bytes_at, labels
        self.out = Mapped()

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.bytes_at[self.at[a]], self.bytes_at[self.at[b - 1] + 1]

    def verbatim(self, a: int, b: int) -> None:
        self.out.add(self.source[a:b], [self.span(k, k + 1) for k in range(a, b)])

    def whole(self, text: str, a: int, b: int) -> None:
        self.out.add(text, [self.span(a, b)] * len(text))

    def run(self) -> Mapped:
        self._text(0, len(self.source))
        return self.out

    def _text(self, a: int, b: int) -> None:
        markers = self._emphasis(a, b)
        k = a
        s = self.source
        while k < b:
            c = s[k]
            if k in markers:
                k += 1
            elif c == "\\" and k + 1 < b and s[k + 1] in PUNCTUATION:
                self.verbatim(k + 1, k + 2)
                k += 2
            elif c == "\\" and k + 1 < b and s[k + 1] == "\n":
                self.whole("\n", k, k + 2)
                k += 2
            elif c == "\n" or c == " " and re.match(r" +\n", s[k:b]):
                m = re.match(r" *\n[ \t]*", s[k:b])
                self.whole("\n", k, k + m.end())
                k += m.end()
            elif c == "`":
                k = self._code(k, b)
            elif c == "&" and (m := ENTITY.match(s, k, b)):
                self.whole(html.unescape(m[0]), k, m.end())
                k = m.end()
            elif c == "<" and (m := AUTOLINK.match(s, k, b)):
                self.verbatim(k + 1, m.end() - 1)
                k = m.end()
            elif c == "<" and (m := RAW_HTML.match(s, k, b)):
                k = m.end()
            elif c == "[" or c == "!" and k + 1 < b and s[k + 1] == "[":
                k = self._link(k, b)
            else:
                self.verbatim(k, k + 1)
                k += 1

    def _code(self, k: int, b: int) -> int:
        ticks = re.compile("`+").match(self.source, k)[0]
        for m in re.compile("`+").finditer(self.source, k + len(ticks), b):
            if m[0] == ticks:
                x, y = k + len(ticks), m.start()
                body = self.source[x:y]
                if len(body) > 2 and body[0] in " \n" and body[-1] in " \n" and body.strip(" \n"):
                    x, y = x + 1, y - 1
                for j in range(x, y):
                    self.whole(" " if self.source[j] == "\n" else self.source[j], j, j + 1)
                return m.end()
        self.verbatim(k, k + len(ticks))
        return k + len(ticks)

    def _closing(self, k: int, b: int) -> int:
        """The bracket that closes the one at k, or -1; code spans and escapes are stepped over."""
        depth = 0
        while k < b:
            c = self.source[k]
            if c == "\\":
                k += 1
            elif c == "`":
                ticks = re.compile("`+").match(self.source, k)[0]
                ends = [m.end() for m in re.compile("`+").finditer(self.source, k + len(ticks), b) if m[0] == ticks]
                k = (ends[0] if ends else k + len(ticks)) - 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if depth == 0:
                    return k
            k += 1
        return -1

    def _link(self, k: int, b: int) -> int:
        opening = k + 1 if self.source[k] == "!" else k
        close = self._closing(opening, b)
        if close > 0:
            after = None
            if m := TARGET.match(self.source, close + 1, b):
                after = m.end()
            elif m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(self.source, close + 1, b):
                if _label(m[1] or self.source[opening + 1 : close]) in self.labels:
                    after = m.end()
            elif _label(self.source[opening + 1 : close]) in self.labels:
                after = close + 1
            if after:
                self._text(opening + 1, close)
                return after
        self.verbatim(k, opening + 1)
        return opening + 1

    def _emphasis(self, a: int, b: int) -> set[int]:
        """Places of * and _ that open or close emphasis."""
        s, runs, k = self.source, [], a
        while k < b:
            if s[k] == "\\":
                k += 2
                continue
            if s[k] == "`":
                ticks = re.compile("`+").match(s, k)[0]
                ends = [m.end() for m in re.compile("`+").finditer(s, k + len(ticks), b) if m[0] == ticks]
                k = ends[0] if ends else k + len(ticks)
                continue
            if s[k] == "<" and (m := AUTOLINK.match(s, k, b) or RAW_HTML.match(s, k, b)):
                k = m.end()
                continue
            if s[k] in "*_":
                end = k
                while end < b and s[end] == s[k]:
                    end += 1
                before, after = s[k - 1] if k > a else " ", s[end] if end < b else " "
                blank = lambda c: c.isspace()
                sign = lambda c: not c.isalnum() and not c.isspace()
                left = not blank(after) and (not sign(after) or blank(before) or sign(before))
                right = not blank(before) and (not sign(before) or blank(after) or sign(after))
                opens = left and (s[k] == "*" or not right or sign(before))
                closes = right and (s[k] == "*" or not left or sign(after))
                runs.append([s[k], list(range(k, end)), opens, closes, end - k])
                k = end
                continue
            k += 1
        used: set[int] = set()
        for i, closer in enumerate(runs):
            j = i - 1
            while closer[3] and closer[1] and j >= 0:
                opener = runs[j]
                odd = (opener[3] or closer[2]) and (opener[4] + closer[4]) % 3 == 0 and (opener[4] % 3 or closer[4] % 3)
                if opener[0] == closer[0] and opener[2] and opener[1] and not odd:
                    n = 2 if len(opener[1]) > 1 and len(closer[1]) > 1 else 1
                    for _ in range(n):
                        used |= {opener[1].pop(), closer[1].pop(0)}
                    for between in runs[j + 1 : i]:
                        between[1] = []
                else:
                    j -= 1
        return used


@dataclass
class Block:
    text: Mapped
    start: int


@dataclass
class Chunk:
    body: str
    start: int
    end: int


def _leaves(node: Container, above: list[list]) -> Iterator[tuple[Leaf, list[list]]]:
    """Leaves with the open containers around them, as [start, claimed] that whoever reads may mark."""
    for child in node.children:
        if isinstance(child, Leaf):
            yield child, above
        else:
            yield from _leaves(child, [*above, [child.start, False]])


def _claim(leaf: Leaf, above: list[list]) -> int:
    """Where a leaf with text starts: at the outermost block around it that has had no text yet."""
    start = next((c[0] for c in above if not c[1]), leaf.start)
    for c in above:
        c[1] = True
    return start


def _document_lines(text: str) -> list[Line]:
    """The lines after the front matter; one that is never closed is part of the text."""
    lines, at = [], 0
    for raw in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text):
        body = raw.rstrip("\r\n")
        lines.append(Line(body, list(range(at, at + len(body)))))
        at += len(raw)
    if lines and re.fullmatch(r"---[ \t]*", lines[0].text) and len(lines) > 1 and lines[1].text.strip():
        for k in range(1, len(lines)):
            if re.fullmatch(r"(?:---|\.\.\.)[ \t]*", lines[k].text):
                return lines[k + 1 :]
    return lines


def sections(text: str) -> tuple[list[list[Block]], list[int]]:
    """The blocks of each section, its heading in front of the first; and the byte of every character."""
    bytes_at = [0]
    for c in text:
        bytes_at.append(bytes_at[-1] + len(c.encode("utf-8", "surrogatepass")))
    lines = _document_lines(text)
    blocks, root = Blocks(), Container("document", 0)
    blocks.parse(lines, root, len(text))
    found: list[list[Block]] = [[]]
    heading: Block | None = None
    waiting: int | None = None  # the start of a heading without text, which the next block takes over

    def close() -> None:
        nonlocal heading, waiting
        if heading is not None:
            if heading.text.text:
                if found[-1]:
                    heading.text.join(found[-1][0].text)
                    found[-1][0] = heading
                else:
                    found[-1].append(heading)
            elif found[-1]:
                found[-1][0].start = heading.start
            else:
                waiting = heading.start
        heading = None

    for leaf, above in _leaves(root, []):
        if leaf.kind == "heading":
            close()
            start = _claim(leaf, above)
            start, waiting = (waiting, None) if waiting is not None else (start, None)
            found.append([])
            heading = Block(Inline(leaf, bytes_at, blocks.labels).run().trimmed(), bytes_at[start])
            heading.start = start
        elif leaf.kind in ("paragraph", "code"):
            mapped = Inline(leaf, bytes_at, blocks.labels).run() if leaf.kind == "paragraph" else _code_text(leaf, bytes_at, len(text))
            mapped = mapped.trimmed()
            if mapped.text:
                start = _claim(leaf, above)
                if waiting is not None:
                    start, waiting = waiting, None
                found[-1].append(Block(mapped, start))
    close()
    for section in found:
        for block in section:
            block.start = bytes_at[block.start]
    return found, bytes_at


def _code_text(leaf: Leaf, bytes_at: list[int], end: int) -> Mapped:
    out = Mapped()
    for line in leaf.lines:
        out.add(line.text, [(bytes_at[k], bytes_at[k + 1]) for k in line.at])
        after = line.at[-1] + 1 if line.at else None
        out.add("\n", [(bytes_at[after], bytes_at[min(after + 1, end)]) if after is not None and after < end else None])
    return out


def packed(blocks: list[Block]) -> Iterator[Block]:
    """Blocks joined while they fit a window; one that does not fit alone is split with overlap."""
    held: Block | None = None
    for block in blocks:
        size = len(block.text.text)
        if held and (size > WINDOW_CHARS or len(held.text.text) + 2 + size > WINDOW_CHARS):
            yield held
            held = None
        if size > WINDOW_CHARS:
            yield from windows(block)
        elif held:
            held.text.join(block.text)
        else:
            held = Block(Mapped(block.text.text, list(block.text.spans)), block.start)
    if held:
        yield held


def windows(block: Block) -> Iterator[Block]:
    size, at = len(block.text.text), 0
    while True:
        piece = block.text.part(at, at + WINDOW_CHARS)
        start = block.text.start(at) if at else None
        yield Block(piece, block.start if start is None else start)
        if at + WINDOW_CHARS >= size:
            return
        at += WINDOW_CHARS - OVERLAP_CHARS


def chunk_markdown(text: str) -> list[Chunk]:
    """Chunks whose ranges tile the UTF-8 bytes of the document; a document without text is one empty chunk."""
    found, bytes_at = sections(text)
    drafts = [b for section in found for b in packed(section)]
    total = bytes_at[-1]
    if not drafts:
        return [Chunk("", 0, total)]
    ends = [d.start for d in drafts[1:]] + [total]
    return [Chunk(d.text.text, 0 if k == 0 else d.start, max(ends[k], d.text.end() or 0)) for k, d in enumerate(drafts)]


def markdown_chunks(sources: DataFrame) -> DataFrame:
    """sources (with content) as chunks, numbered from 0 within each document."""

    @F.pandas_udf("array<struct<body:string,source_start:bigint,source_end:bigint>>")
    def cut(contents: pd.Series) -> pd.Series:
        return contents.map(lambda text: [{"body": c.body, "source_start": c.start, "source_end": c.end} for c in chunk_markdown(text or "")])

    keep = [c for c in sources.columns if c != "content"]
    out = sources.select(*keep, F.posexplode(cut("content")).alias("chunk_sequence", "_c"))
    return out.select(*keep, F.col("chunk_sequence").cast("long").alias("chunk_sequence"), "_c.body", "_c.source_start", "_c.source_end")
