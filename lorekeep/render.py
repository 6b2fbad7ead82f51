"""Search responses, collection lists and status as text, JSON, Markdown and XML."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from lorekeep.plans.search import Hit, SearchResponse

FORMATS = ("human", "json", "md", "xml")
CYAN, YELLOW, RESET = "\x1b[36m", "\x1b[33m", "\x1b[0m"
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


@dataclass(frozen=True)
class CollectionRow:
    name: str
    path: str
    description: str | None
    document_count: int


@dataclass(frozen=True)
class StatusReport:
    version: str
    embedding_model: str
    vector_dim: int
    collections: int
    chunks: int
    sources: int


def xml_escape(text: str) -> str:
    """G12, for what the driver prints."""
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]", "\ufffd", text)


def shown(line: str) -> str:
    """Control characters but tabs as escapes, so that a document cannot steer a terminal."""
    return "".join(f"\\u{{{ord(c):x}}}" if unicodedata.category(c) == "Cc" and c != "\t" else c for c in line)


def score_text(score: float) -> str:
    """The shortest decimal that gives back the 32-bit number."""
    if not np.isfinite(score):
        return "null"
    text = np.format_float_positional(np.float32(score), unique=True, trim="0")
    return text


def _lines(snippet: str) -> list[str]:
    return [x.removesuffix("\r") for x in snippet.removesuffix("\n").split("\n")] if snippet else []


def _footer(r: SearchResponse) -> str:
    return f"{r.total} {r.level} hits (showing {r.limit} max)"


def _fields(hit: Hit) -> dict[str, object]:
    """In the order of the envelope: a chunk has its number before the score, a document its matches after the snippet."""
    out: dict[str, object] = {"collection": hit.collection, "path": hit.path}
    if hit.chunk_sequence is not None:
        out["chunk_sequence"] = hit.chunk_sequence
    out |= {"score": hit.score, "snippet": hit.snippet}
    if hit.matched_chunks is not None:
        out["matched_chunks"] = hit.matched_chunks
    return out | {"chunk_count": hit.chunk_count}


def as_dict(r: SearchResponse) -> dict[str, object]:
    return {"query": r.query, "mode": r.mode, "level": r.level, "collections": list(r.collections), "limit": r.limit, "total": r.total, "hits": [_fields(h) for h in r.hits]}


def _human(r: SearchResponse, color: bool) -> str:
    out = []
    for h in r.hits:
        name, score = f"{h.collection}/{h.path}", f"score={h.score:.3f}"
        if color:
            name, score = f"{CYAN}{name}{RESET}", f"{YELLOW}{score}{RESET}"
        out += [f"{name}  {score}  chunks={h.chunk_count}", *(f"  > {shown(x)}" for x in _lines(h.snippet)), "---"]
    return "\n".join([*out, _footer(r), ""])


def _json(r: SearchResponse) -> str:
    """One line; scores as 32-bit numbers."""
    marks: list[str] = []

    def mark(h: dict[str, object]) -> dict[str, object]:
        marks.append(score_text(float(h["score"])))  # type: ignore[arg-type]
        return h | {"score": f"\x00{len(marks) - 1}\x00"}

    tree = as_dict(r)
    tree["hits"] = [mark(h) for h in tree["hits"]]  # type: ignore[union-attr]
    text = json.dumps(tree, ensure_ascii=False, separators=(",", ":"))
    return re.sub(r'"\\u0000(\d+)\\u0000"', lambda m: marks[int(m[1])], text) + "\n"


def _md(r: SearchResponse) -> str:
    out = ["# Search results", "", f"- query: `{r.query}`", f"- mode: {r.mode}", f"- level: {r.level}", f"- collections: {', '.join(r.collections) or '(all)'}", f"- {_footer(r)}"]
    for h in r.hits:
        own = f"- matched_chunks: {h.matched_chunks}" if h.chunk_sequence is None else f"- chunk_sequence: {h.chunk_sequence}"
        out += ["", f"## {h.collection}/{h.path}", "", own, f"- score: {h.score:.3f}", f"- chunk_count: {h.chunk_count}", "", *(f"> {shown(x)}" for x in _lines(h.snippet))]
    return "\n".join([*out, ""])


def _element(name: str, value: object, depth: int) -> str:
    text = score_text(value) if isinstance(value, float) else xml_escape(str(value))
    return f"{'  ' * depth}<{name}>{text}</{name}>"


def _group(name: str, rows: list[str], depth: int) -> list[str]:
    pad = "  " * depth
    return [f"{pad}<{name}>", *rows, f"{pad}</{name}>"] if rows else [f"{pad}<{name}/>"]


def _xml(r: SearchResponse) -> str:
    hits: list[str] = []
    for h in r.hits:
        hits += _group("hit", [_element(k, v, 3) for k, v in _fields(h).items()], 2)
    names = [_element("collection", c, 2) for c in r.collections]
    body = [_element(k, v, 1) for k, v in (("query", r.query), ("mode", r.mode), ("level", r.level))]
    body += [*_group("collections", names, 1), _element("limit", r.limit, 1), _element("total", r.total, 1), *_group("hits", hits, 1)]
    return "\n".join([DECLARATION, *_group("response", body, 0), ""])


def render(r: SearchResponse, form: str, *, color: bool = False) -> str:
    return _human(r, color) if form == "human" else {"json": _json, "md": _md, "xml": _xml}[form](r)


def render_collections(rows: Sequence[CollectionRow], form: str) -> str:
    """G14."""
    if form == "json":
        listed = [{"name": c.name, "path": c.path, "description": c.description, "document_count": c.document_count} for c in rows]
        return json.dumps({"collections": listed}, ensure_ascii=False, separators=(",", ":")) + "\n"
    if form == "md":
        out = ["# Collections", "", f"- {len(rows)} collections"]
        for c in rows:
            out += ["", f"## {c.name}", "", f"- path: `{c.path}`", f"- document_count: {c.document_count}", f"- description: {c.description or '(none)'}"]
        return "\n".join([*out, ""])
    if form == "xml":
        body: list[str] = []
        for c in rows:
            described = _element("description", c.description, 2) if c.description is not None else "    <description/>"
            body += _group("collection", [_element("name", c.name, 2), _element("path", c.path, 2), described, _element("document_count", c.document_count, 2)], 1)
        return "\n".join([DECLARATION, *_group("collections", body, 0), ""])
    out = [f"{c.name}\t{c.path}\t{c.document_count} docs\t{c.description or '(none)'}" for c in rows]
    return "\n".join([*out, f"{len(rows)} collections", ""])


def render_status(s: StatusReport, form: str) -> str:
    """G14."""
    fields = s.__dict__
    if form == "json":
        return json.dumps(fields, ensure_ascii=False, separators=(",", ":")) + "\n"
    if form == "md":
        return "\n".join(["# Status", "", *(f"- {k}: `{v}`" if k == "embedding_model" else f"- {k}: {v}" for k, v in fields.items()), ""])
    if form == "xml":
        return "\n".join([DECLARATION, *_group("status", [_element(k, v, 1) for k, v in fields.items()], 0), ""])
    return "\n".join([*(f"{k + ':':<16} {v}" for k, v in fields.items()), ""])
