"""Secrets by pattern and by assignment-aware lexing.

Base patterns find assignments to a few names, access keys and hexadecimal runs. The lexer then reads source and
configuration syntax into pairs of a name and a value: assignments, maps, calls that set something, flags, elements
and attributes of XML, lists and block scalars of YAML, and what is written so inside of strings and comments. Values
are literals, other names, or pieces of both joined by + or by interpolation. Pairs take effect in the order of the
text: a name stands for what was assigned to it last. Each literal is scored by the sensitive names that it reaches
and by how little it looks like a word, a place holder or prose.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import ship

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "lexed")
#: Fixed patterns of the base: kind, pattern, the group and the length it must have.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: What an assignment of ASSIGN needs, to leave most texts unread.
STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LITERAL = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`|\$?\{?(?:[A-Za-z0-9_+/.=~$@%!?*^|:-]++|&(?![A-Za-z_][\w.-]*+=(?!=)))++\}?"
STRING = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
#: A name, quoted or in brackets, an operator, and where its value starts.
PAIR = re.compile(rf"(?<![\w.-])([\"']?)([A-Za-z_$][\w.$-]*+)\1\]?[ \t]*+(?::=|=>|[:=](?!=))[ \t]*+({LITERAL})", re.A)
CALL = re.compile(rf"(?<![\w.$])([A-Za-z_$][\w.$]*+)\([ \t\n]*+({STRING})[ \t\n]*+(?:,[ \t\n]*+({STRING})[ \t\n]*+)?\)", re.A)
#: Calls that ask for what their name says.
GETTER = re.compile(r"(?:[\w$]+\.)*(?:get|fetch|load|read|find|is|has|check|verify|ask|prompt)(?![a-z])", re.A)
FLAG = re.compile(rf"(?<![\w-])--([A-Za-z][\w-]*+)[ \t]++(?!-)({LITERAL})", re.A)
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:[ \t\n][^<>]*+)?>[ \t\n]*+([^<>\n]*[^<>\s])[ \t\n]*+</\1[ \t]*+>", re.A)
ATTRIBUTES = re.compile(rf"(?<![\w-])(?:key|name|id)[ \t]*+=[ \t]*+({STRING})[ \t\n]++value[ \t]*+=[ \t]*+({STRING})", re.A)
#: A key of YAML whose value stands on the lines below: an item each, or a block scalar.
BLOCK = re.compile(r"^([ \t]*+(?:- )?)([\"']?)([A-Za-z_][\w.-]*+)\2[ \t]*+:[ \t]*+([|>][+-]?)?[ \t]*+(?:#[^\n]*+)?\n", re.A | re.M)
#: Comments: pairs in them are pairs, but assign nothing.
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?:(?<=\s)|\A)(?://|#|-- )[^\n]*+", re.S)
INTERPOLATED = re.compile(r"\$\{([A-Za-z_][\w.-]*)\}", re.A)
#: What names of sensitive words hold: texts without any are not lexed.
TELLING = re.compile("passw|pwd|passphrase|passcode|secret|token|key|credential|bearer")
#: Characters of a value that are scored; its spans are all reported.
SCORED = 512
JOINED = re.compile(rf"[ \t]*+\+[ \t]*+({LITERAL})")
NAME = re.compile(r"\$?\{?([A-Za-z_][\w.-]*)\}?", re.A)
#: Sensitive words of a name and their weight; pairs that only count together.
SENSITIVE = {"password": 0.7, "passwd": 0.7, "pwd": 0.7, "passphrase": 0.7, "passcode": 0.7, "secret": 0.7, "token": 0.6, "apikey": 0.7, "credential": 0.6, "credentials": 0.6, "privatekey": 0.7, "accesskey": 0.7, "bearer": 0.5}
PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("auth", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("auth", "token"), ("client", "secret")}
#: Literals that stand for a secret to be filled in.
HOLLOW = re.compile(r"(?i)change_?me|example|placeholder|your[_-]|dummy|sample|redacted|xxx|\*\*\*|todo|none$|null$|true$|false$|undefined$|^\W*$")
THRESHOLD = 1.0


def name_weight(name: str) -> float:
    """How sensitive a name is, by its words (split at case, digits and punctuation)."""
    words = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())
    most = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max(most, 0.7) if any(p in PAIRS for p in zip(words, words[1:], strict=False)) else most


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: length, mixture of characters, entropy."""
    if len(value) < 6 or HOLLOW.search(value) or re.search(r"\s", value):
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    if kinds == 1 and len(value) < 20:  # a word or a number
        return 0.0
    return 0.1 * min(kinds, 3) + 0.1 * (len(value) >= 12) + 0.3 * min(bits, 4) / 4


class Value:
    """What a name stands for: pieces that are literals (start, end), open names (name, start, end) or other values."""

    __slots__ = ("parts", "reported", "text")

    def __init__(self, parts: list, text: str):
        self.parts, self.text, self.reported = parts, text, False

    def literals(self) -> Iterator[tuple[int, int]]:
        """Spans of its literals that were not given before: over all values, each piece is visited once."""
        left = [self]
        while left:
            value = left.pop()
            if not value.reported:
                value.reported = True
                for part in value.parts:
                    if isinstance(part, Value):
                        left.append(part)
                    elif part[-2] < part[-1]:
                        yield part[-2:]


def _pieces(text: str, start: int, raw: str) -> list:
    """The pieces of an operand that starts at `start`: a string, with what is interpolated, or a word that may be a name."""
    if raw[:1] not in "\"'`":
        name = NAME.fullmatch(raw)
        return [(name[1], start, start + len(raw))] if name else [(start, start + len(raw))]
    at, end, found = start + 1, start + len(raw) - 1, []
    for m in INTERPOLATED.finditer(text, at, end):
        found += [(at, m.start()), (m[1], m.start(), m.end())]
        at = m.end()
    return [p for p in [*found, (at, end)] if len(p) == 3 or p[0] < p[1]] or [(at, end)]


def _operands(text: str, m: re.Match) -> tuple[list, int]:
    """The pieces of a pair's value, and where to look for the next pair: inside it, as it may hold others."""
    raw = m[3] if m[3][:1] in "\"'`" else m[3].rstrip(".,:;")
    if raw[-1:] == "}" and "{" not in raw:  # that of a map around the pair
        raw = raw[:-1]
    quoted = raw[:1] in "\"'`"
    if not quoted and text[m.end(3) : m.end(3) + 1] == "(":  # a call, no literal
        return [], m.start(3)
    found, stop = _pieces(text, m.start(3), raw), m.end(3)
    while more := JOINED.match(text, stop):
        found += _pieces(text, more.start(1), more[1])
        stop = more.end()
    return found, m.start(3) + quoted


def _block(text: str, m: re.Match) -> list[list]:
    """The values under a key of YAML: one of all lines of a block scalar, or one for each item of a list."""
    indent, at, found = len(m[1]), m.end(), []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        body = line.lstrip(" \t")
        deep = len(line) - len(body)
        if body and (deep < indent or deep == indent and (m[4] or not body.startswith("- "))):
            break
        if m[4] and body:
            found.append((at + deep, at + len(line.rstrip())))
        elif body:
            if not (item := re.match(r"-[ \t]++", body)) or PAIR.match(body, item.end()):
                break
            raw = body[item.end() :].rstrip()
            if raw:
                found.append(_pieces(text, at + deep + item.end(), raw if raw[:1] not in "\"'`" or raw[-1:] == raw[:1] and len(raw) > 1 else raw[1:]))
        at = end + 1
    return [found] if m[4] and found else [] if m[4] else found


def pairs(text: str) -> list[tuple[int, str, list]]:
    """(place, name, pieces) of every pair of a text in the order of their places."""
    found: list[tuple[int, str, list]] = []
    place, typed, name = 0, -1, ""
    while m := PAIR.search(text, place):
        pieces, place = _operands(text, m)
        if pieces:
            found.append((m.start(2), m[2], pieces))
            if m.start(2) == typed and text[m.end(2) : m.start(3)].strip() == "=":  # what stood there was a type: name: type = value
                found.append((m.start(2), name, pieces))
        typed, name = m.start(3), m[2]
    for m in CALL.finditer(text):
        if m[3] is None:
            if not GETTER.match(m[1]):
                found.append((m.start(2), m[1], _pieces(text, m.start(2), m[2])))
        else:
            found.append((m.start(2), m[2][1:-1], _pieces(text, m.start(3), m[3])))
    found += [(m.start(1), m[1], _pieces(text, m.start(2), m[2])) for m in FLAG.finditer(text)]
    found += [(m.start(1), m[1], [m.span(2)]) for m in ELEMENT.finditer(text)]
    found += [(m.start(1), m[1][1:-1], _pieces(text, m.start(2), m[2])) for m in ATTRIBUTES.finditer(text)]
    for m in BLOCK.finditer(text):
        if name_weight(m[3]):
            found += [(m.start(3), m[3], pieces) for pieces in _block(text, m)]
    return sorted(found, key=lambda p: p[0])


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name."""
    if not TELLING.search(text.lower()):
        return []
    comments = iter([m.span() for m in COMMENT.finditer(text)])
    comment = next(comments, (len(text), len(text)))
    held: dict[str, Value] = {}
    waiting: list[tuple[float, str, Value]] = []
    spans: set[tuple[int, int]] = set()
    for place, name, pieces in pairs(text):
        while comment[1] <= place < len(text):
            comment = next(comments, (len(text), len(text)))
        parts: list = [held.get(p[0], p) if len(p) == 3 else p for p in pieces]
        value = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts, "".join(p.text if isinstance(p, Value) else text[p[-2] : p[-1]][:SCORED] for p in parts)[:SCORED])
        if weight := name_weight(name):
            if len(parts) == 1 and len(parts[0] if isinstance(parts[0], tuple) else ()) == 3:
                waiting.append((weight, name, value))  # the name may be assigned further on
            elif weight + literal_weight(value.text) >= THRESHOLD:
                spans.update(value.literals())
        if not comment[0] <= place < comment[1]:
            held[name] = value
    for weight, name, value in waiting:
        seen = {name}
        while len(value.parts) == 1 and not isinstance(value.parts[0], Value) and len(value.parts[0]) == 3 and (other := value.parts[0][0]) in held and other not in seen:
            seen.add(other)
            value = held[other]
        if weight + literal_weight(value.text) >= THRESHOLD and not (len(value.parts) == 1 and not isinstance(value.parts[0], Value) and len(value.parts[0]) == 3 and value.parts[0][0] in seen):
            spans.update(value.literals())
    return sorted(spans)


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of a text, in code points, in the order of the listing."""
    found = []
    low = text.lower()
    if any(s in low for s in STEMS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("lexed", a, b) for a, b in lexed(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, n_lexed, base_spans, spans.

    Spans are written kind:start:end, in code points, end exclusive, by start and then kind, joined by commas.
    A null text is empty. Texts are lexed whole, however long, in a time that grows with their length. Repeated rows are
    each returned; empty table: empty result. Other columns are not read.
    """
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every = [], [], []
            for text in batch.column("text"):
                found = secrets(text.as_py() or "")
                counts.append([sum(x[0] == k for x in found) for k in KINDS])
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b in found if k != "lexed"))
                every.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, f"doc_id long, {kinds}, base_spans string, spans string")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
