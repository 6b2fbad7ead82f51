"""The documents under a directory, ignore rules and links."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

EXTENSIONS = {"md": "markdown", "markdown": "markdown", "pdf": "pdf"}
#: What makes a directory a repository, in which alone ignore files count.
MARKERS = (".git", ".jj")
IGNORE_FILE = ".gitignore"
SCHEMA = "collection string, path string, mtime timestamp, size long, file string"


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: below `base`, whether it takes back, whether it is for directories alone."""

    base: str
    pattern: re.Pattern[str]
    negated: bool
    directories: bool


def format_of(name: str) -> str | None:
    """By extension, whatever its case; a name that is all extension has none."""
    stem, dot, extension = name.rpartition(".")
    return EXTENSIONS.get(extension.lower()) if dot and stem else None


def _glob(text: str) -> str:
    """A pattern's segments as a regular expression; ``*`` and ``?`` stay within a segment."""
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if text.startswith("**/", at) and (at == 0 or text[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
            continue
        if text[at:] == "**" and (at == 0 or text[at - 1] == "/"):
            return out + ".+"
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := text.find("]", at + 2)) > 0:
            body = text[at + 1 : end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out += "(?!/)[" + body.replace("\\", "\\\\").replace("[", "\\[") + "]"
            at = end
        elif c == "\\" and at + 1 < len(text):
            at += 1
            out += re.escape(text[at])
        else:
            out += re.escape(c)
        at += 1
    return out


def parse_rules(text: str, base: str) -> list[Rule]:
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        directories = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        if line:
            rules.append(Rule(base, re.compile(("" if anchored else "(?:.*/)?") + _glob(line) + r"\Z", re.S), negated, directories))
    return rules


def ignored(path: str, is_dir: bool, rules: list[Rule]) -> bool:
    """Whether the last rule that fits an absolute path leaves it out."""
    for rule in reversed(rules):
        if (not rule.directories or is_dir) and path.startswith(rule.base + "/") and rule.pattern.match(path[len(rule.base) + 1 :]):
            return not rule.negated
    return False


def _rules_in(directory: str) -> list[Rule]:
    try:
        with open(os.path.join(directory, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
            return parse_rules(f.read(), directory)
    except OSError:
        return []


def _repository(directory: str) -> str | None:
    """The nearest directory at or above that is a repository."""
    while True:
        if any(os.path.lexists(os.path.join(directory, m)) for m in MARKERS):
            return directory
        above = os.path.dirname(directory)
        if above == directory:
            return None
        directory = above


def walk(root: str) -> Iterator[tuple[str, os.stat_result]]:
    """(path relative to root, status) of every document file, hidden ones too, in order of paths.

    A root that is a link is followed, links below are not. Ignore files count inside a repository only, those
    of its directories above the root included; the root itself is never left out.
    """
    top = os.path.realpath(root)
    rules: list[Rule] = []
    if home := _repository(top):
        above, chain = top, []
        while above != home:
            above = os.path.dirname(above)
            chain.append(above)
        for directory in reversed(chain):
            rules += _rules_in(directory)

    def below(directory: str, prefix: str, rules: list[Rule], inside: bool) -> Iterator[tuple[str, os.stat_result]]:
        inside = inside or any(os.path.lexists(os.path.join(directory, m)) for m in MARKERS)
        rules = rules + _rules_in(directory) if inside else rules
        try:
            entries = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.is_symlink() or inside and (entry.name in MARKERS or ignored(entry.path, is_dir, rules)):
                continue
            if is_dir:
                yield from below(entry.path, f"{prefix}{entry.name}/", rules, inside)
            elif entry.is_file(follow_symlinks=False) and format_of(entry.name):
                yield prefix + entry.name, entry.stat()

    if os.path.isdir(top):
        yield from below(top, "", rules, home is not None)


def listing(spark: SparkSession, collection: str, root: str) -> DataFrame:
    """(collection, path, mtime, size, file) of the documents under root; times in whole microseconds."""
    rows = []
    top = os.path.realpath(root)
    for path, status in walk(root):
        rows.append((collection, path, status.st_mtime_ns // 1000, status.st_size, os.path.join(top, path)))
    found = spark.createDataFrame(rows, "collection string, path string, micros long, size long, file string")
    return found.selectExpr("collection", "path", "timestamp_micros(micros) AS mtime", "size", "file")
