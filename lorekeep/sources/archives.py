"""Documents in zip and tar archives, read strictly.

What the formats leave open and what damaged or crafted files do is settled so that no document is silently
lost: an archive that is not exactly what its format says is unreadable as a whole, and a document whose data
is broken fails alone.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from lorekeep.errors import ArchiveError, ExtractError
from lorekeep.sources.walker import EXTENSIONS

MAX_DOCUMENT = 256 << 20
MAX_NAMES, NAME_COST = 256 << 20, 128
BLOCK = 512
MAX_FRAGMENTS = 1 << 20


@dataclass
class Document:
    """A document of an archive: its path, place among the entries, and how its bytes are read."""

    path: str
    position: int
    read: Callable[[], bytes]


@dataclass
class Listing:
    """The documents, one a path (the last entry wins), rejected names, and the file's stamp (time, size)."""

    documents: dict[str, Document]
    rejected: list[tuple[str, str]]
    stamp: tuple[int, int]


def archive_kind(path: str) -> str | None:
    """Zip, tar or tar.gz by the name's end, whatever its case."""
    name = os.path.basename(path).lower()
    if name.endswith((".tar.gz", ".tgz")):
        return "tar.gz"
    return "tar" if name.endswith(".tar") else "zip" if name.endswith(".zip") else None


def _decoded(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def classify_name(raw: bytes) -> tuple[str, str]:
    """(``ignored``, ''), (``rejected``, why) or (``document``, path) for an entry's name as stored."""
    name = _decoded(raw)
    parts = raw.replace(b"\\", b"/").split(b"/") if name is not None else raw.split(b"/")
    stem, dot, extension = parts[-1].rpartition(b".")
    if not dot or not stem or extension.decode("latin-1").lower() not in EXTENSIONS:
        return "ignored", ""
    plain = [p for p in raw.replace(b"\\", b"/").split(b"/") if p not in (b"", b".")]
    if parts[-1].startswith(b"._") or plain[0] == b"__MACOSX" and len(plain) > 1:
        return "ignored", ""
    if name is None:
        return "rejected", "name is not UTF-8"
    name = name.replace("\\", "/")
    path = "/".join(p for p in name.split("/") if p not in ("", "."))
    for form in (name, path):
        if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in form):
            return "rejected", "control character in name"
        if form.startswith("/") or len(form) > 1 and form[0].isascii() and form[0].isalpha() and form[1] == ":":
            return "rejected", "absolute name"
        if ".." in form.split("/"):
            return "rejected", "name leaves the archive"
    return "document", path


def _stamp(file: str) -> tuple[int, int]:
    status = os.stat(file)
    return status.st_mtime_ns, status.st_size


def listed(file: str, *, max_names: int = MAX_NAMES, max_document: int = MAX_DOCUMENT) -> Listing:
    """One pass over the archive; ArchiveError where any of it is not as its format says, or it changes meanwhile."""
    stamp = _stamp(file)
    kind = archive_kind(file)
    documents: dict[str, Document] = {}
    rejected: list[tuple[str, str]] = []
    names = 0
    entries = zip_entries(file, max_document) if kind == "zip" else tar_entries(file, kind == "tar.gz", max_document)
    for position, (raw, regular, read) in enumerate(entries):
        if not regular:
            continue
        what, path = classify_name(raw)
        if what == "ignored":
            continue
        names += len(raw) + NAME_COST
        if names > max_names:
            raise ArchiveError("the names are too many")
        if what == "rejected":
            rejected.append((raw.decode("utf-8", "backslashreplace"), path))
        else:
            documents[path] = Document(path, position, read)
    if _stamp(file) != stamp:
        raise ArchiveError("the archive changed while it was listed")
    return Listing(documents, rejected, stamp)


def contents(file: str, wanted: set[str], *, max_document: int = MAX_DOCUMENT) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, bytes, error) of the wanted documents in the archive's order; stops where the file changes."""
    found = listed(file, max_document=max_document)
    for document in sorted(found.documents.values(), key=lambda d: d.position):
        if document.path in wanted:
            try:
                data, error = document.read(), None
            except ExtractError as e:
                data, error = None, str(e)
            if _stamp(file) != found.stamp:
                return
            yield document.path, data, error


# Zip


def _zip64(extra: bytes, wanted: list[str], values: dict[str, int]) -> None:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            body, place = extra[at + 4 : at + 4 + size], 0
            for name in wanted:
                width = 4 if name == "disk" else 8
                if place + width > len(body):
                    raise ArchiveError("a zip64 field is too short")
                values[name] = int.from_bytes(body[place : place + width], "little")
                place += width
            return
        at += 4 + size
    if wanted:
        raise ArchiveError("a zip64 field is missing")


def _zip_directory(f: BinaryIO, size: int) -> tuple[int, int, int]:
    """(start, end, entries) of the central directory, by the one end record that fits."""
    span = min(size, 65_557)
    f.seek(size - span)
    tail = f.read(span)
    found, failure = [], ArchiveError("no end record")
    at = tail.find(b"PK\5\6")
    while at >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail):
            try:
                found.append(_zip_end(f, size - span + at, tail[at : at + 22]))
            except ArchiveError as e:
                failure = e
        at = tail.find(b"PK\5\6", at + 1)
    if len(found) > 1:
        raise ArchiveError("more than one end record")
    if not found:
        raise failure
    return found[0]


def _zip_end(f: BinaryIO, at: int, record: bytes) -> tuple[int, int, int]:
    disk, start_disk, here, entries, length, offset = struct.unpack_from("<HHHHII", record, 4)
    end = at
    if at >= 20:
        f.seek(at - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\6\7":
            _, where, disks = struct.unpack_from("<IQI", locator, 4)
            f.seek(where)
            record = f.read(56)
            if len(record) < 56 or record[:4] != b"PK\6\6" or where + 12 + struct.unpack_from("<Q", record, 4)[0] != at - 20:
                raise ArchiveError("the zip64 end record does not fit")
            disk, start_disk, here, entries, length, offset = struct.unpack_from("<IIQQQQ", record, 16)
            if disks > 1:
                raise ArchiveError("a split zip")
            end = where
    if disk or start_disk or here != entries:
        raise ArchiveError("a split zip")
    if offset + length != end:
        raise ArchiveError("the central directory does not end at the end record")
    return offset, end, entries


def zip_entries(file: str, max_document: int) -> Iterator[tuple[bytes, bool, Callable[[], bytes]]]:
    """Entries of the central directory as (name, regular, read)."""
    with open(file, "rb") as f:
        size = f.seek(0, io.SEEK_END)
        start, end, count = _zip_directory(f, size)
        f.seek(start)
        directory = f.read(end - start)
        at, taken, out = 0, [], []
        for _ in range(count):
            if directory[at : at + 4] != b"PK\1\2" or at + 46 > len(directory):
                raise ArchiveError("a directory entry is missing")
            made, _, flags, method, _, _, crc, packed, full, n, extra, comment, disk, _, attributes, local = struct.unpack_from("<HHHHHHIIIHHHHHII", directory, at + 4)
            stop = at + 46 + n + extra + comment
            if stop > len(directory):
                raise ArchiveError("a directory entry is cut short")
            name = directory[at + 46 : at + 46 + n]
            values = {"full": full, "packed": packed, "local": local, "disk": disk}
            wanted = [k for k in ("full", "packed", "local") if values[k] == 0xFFFFFFFF] + (["disk"] if disk == 0xFFFF else [])
            if wanted:
                _zip64(directory[at + 46 + n : at + 46 + n + extra], wanted, values)
            if values["disk"]:
                raise ArchiveError("a split zip")
            f.seek(values["local"])
            head = f.read(30)
            if len(head) < 30 or head[:4] != b"PK\3\4":
                raise ArchiveError("a local header is missing")
            data = values["local"] + 30 + sum(struct.unpack_from("<HH", head, 26))
            if data + values["packed"] > start:
                raise ArchiveError("data runs into the directory")
            taken.append((values["local"], data + values["packed"]))
            link = made >> 8 == 3 and (attributes >> 28) == 0xA
            out.append((name, not name.endswith(b"/") and not link, _zip_reader(file, data, values["packed"], values["full"], crc, method, flags, max_document)))
            at = stop
        rest = directory[at:]
        if rest and not (rest[:4] == b"PK\5\5" and len(rest) >= 6 and 6 + struct.unpack_from("<H", rest, 4)[0] == len(rest)):
            raise ArchiveError("the directory holds more than it says")
        taken.sort()
        if any(a[1] > b[0] for a, b in zip(taken, taken[1:], strict=False)):
            raise ArchiveError("entries share data")
    yield from out


def _zip_reader(file: str, at: int, packed: int, full: int, crc: int, method: int, flags: int, most: int) -> Callable[[], bytes]:
    def read() -> bytes:
        if flags & 1:
            raise ExtractError("the document is encrypted")
        if method not in (0, 8):
            raise ExtractError(f"compression method {method} is not read")
        with open(file, "rb") as f:
            f.seek(at)
            raw = f.read(packed)
        if method == 8:
            inflater = zlib.decompressobj(-15)
            try:
                data = inflater.decompress(raw, most + 1)
            except zlib.error as e:
                raise ExtractError(str(e)) from e
            if len(data) <= most and (not inflater.eof or inflater.unused_data):
                raise ExtractError("the compressed data does not end where it should")
        else:
            data = raw[: most + 1]
        if len(data) > most:
            raise ExtractError("the document is too large")
        if len(data) != full or zlib.crc32(data) != crc:
            raise ExtractError("size or checksum do not match")
        return data

    return read


# Tar


class _Gzip(io.RawIOBase):
    """The members of a gzip file as one stream; each member's checksum is verified at its end."""

    def __init__(self, f: BinaryIO):
        self.f, self.member, self.ahead, self.done = f, zlib.decompressobj(31), b"", False

    def read(self, n: int = -1) -> bytes:
        parts, left = [], n
        while left > 0 and not self.done:
            if self.member.eof:
                self.ahead = self.member.unused_data or self.ahead or self.f.read(1 << 16)
                if not self.ahead or not self.ahead.strip(b"\0") and not self.f.read(1):
                    self.done = True
                    break
                self.member = zlib.decompressobj(31)
            raw = self.ahead or self.member.unconsumed_tail or self.f.read(1 << 16)
            self.ahead = b""
            if not raw:
                raise ArchiveError("a gzip member is cut short")
            try:
                piece = self.member.decompress(raw, left)
            except zlib.error as e:
                raise ArchiveError(str(e)) from e
            parts.append(piece)
            left -= len(piece)
        return b"".join(parts)

    def finish_member(self) -> None:
        """Read the present member to its end, so that its checksum counts."""
        while not self.member.eof:
            raw = self.member.unconsumed_tail or self.f.read(1 << 16)
            if not raw:
                raise ArchiveError("a gzip member is cut short")
            try:
                self.member.decompress(raw, 1 << 20)
            except zlib.error as e:
                raise ArchiveError(str(e)) from e


def number(field: bytes, *, binary: bool) -> int | None:
    """A tar number: octal between blanks, or GNU's base 256; None if it is neither."""
    if binary and field[:1] == b"\x80":
        value = int.from_bytes(field[1:], "big")
        return value if value < 1 << 63 else None
    body = field.lstrip(b" ")
    digits = body.rstrip(b" \0")
    if digits and all(48 <= c <= 55 for c in digits):
        value = int(digits, 8)
        return value if value < 1 << 63 else None
    return None


def _checked(header: bytes) -> None:
    stored = number(header[148:156], binary=False)
    body = header[:148] + b" " * 8 + header[156:]
    signed = sum(c - 256 if c > 127 else c for c in body)
    if stored is None or stored not in (sum(body), signed):
        raise ArchiveError("a header's checksum does not match")


def _text(field: bytes) -> bytes:
    return field.split(b"\0", 1)[0]


def pax_records(data: bytes) -> dict[str, bytes | list[bytes]]:
    """The records that matter; of GNU.sparse.offset and numbytes all, in order."""
    out: dict[str, bytes | list[bytes]] = {"pairs": []}
    at = 0
    while at < len(data):
        space = data.find(b" ", at)
        length = data[at:space] if space > at else b""
        if not length.isdigit() or at + int(length) > len(data) or int(length) <= space - at + 1:
            raise ArchiveError("a PAX record does not parse")
        record = data[space + 1 : at + int(length)]
        key, equals, value = record[:-1].partition(b"=")
        if record[-1:] != b"\n" or not equals or not key:
            raise ArchiveError("a PAX record does not parse")
        name = key.decode("utf-8", "replace")
        if name in ("GNU.sparse.offset", "GNU.sparse.numbytes"):
            out["pairs"].append(name[11:].encode() + b"=" + value)
        elif name in ("path", "size") or name.startswith("GNU.sparse."):
            if name in ("path", "size") and not value:
                raise ArchiveError(f"an empty PAX {name}")
            out[name] = value
        at += int(length)
    return out


def _decimal(value: bytes) -> int:
    if not value.isdigit() or int(value) >= 1 << 63:
        raise ExtractError("a sparse map holds what is no number")
    return int(value)


def rebuilt(stored: bytes, fragments: list[tuple[int, int]], size: int, most: int) -> bytes:
    """A sparse file from its stored parts."""
    if size > most:
        raise ExtractError("the document is too large")
    if len(fragments) > MAX_FRAGMENTS:
        raise ExtractError("a sparse map has too many fragments")
    out, at, end = bytearray(size), 0, 0
    for offset, length in fragments:
        if offset < end or offset + length > size:
            raise ExtractError("a sparse map is out of order or past the end")
        out[offset : offset + length] = stored[at : at + length]
        at, end = at + length, offset + length
    if at != len(stored):
        raise ExtractError("a sparse map does not describe the stored data")
    return bytes(out)


def _pax_sparse(pax: dict, data: bytes, most: int) -> bytes:
    if pax.get("GNU.sparse.major") == b"1" and pax.get("GNU.sparse.minor") == b"0":
        numbers, at = [], 0
        count = None
        while count is None or len(numbers) < 2 * count:
            end = data.find(b"\n", at)
            if end < 0:
                raise ExtractError("a sparse map is cut short")
            value = _decimal(data[at:end])
            at = end + 1
            if count is None:
                count = value
                if count > MAX_FRAGMENTS:
                    raise ExtractError("a sparse map has too many fragments")
            else:
                numbers.append(value)
        stored = data[-(-at // BLOCK) * BLOCK :]
        return rebuilt(stored, list(zip(numbers[::2], numbers[1::2], strict=True)), _decimal(pax.get("GNU.sparse.realsize", b"")), most)
    if "GNU.sparse.major" in pax or "GNU.sparse.minor" in pax:
        raise ExtractError("a sparse form that is not known")
    size, count = _decimal(pax.get("GNU.sparse.size", b"")), _decimal(pax.get("GNU.sparse.numblocks", b""))
    if "GNU.sparse.map" in pax:
        numbers = [_decimal(x) for x in pax["GNU.sparse.map"].split(b",")] if pax["GNU.sparse.map"] else []
    else:
        keys = [p.partition(b"=")[0] for p in pax["pairs"]]
        if keys != [b"offset", b"numbytes"] * (len(keys) // 2):
            raise ExtractError("sparse records do not pair")
        numbers = [_decimal(p.partition(b"=")[2]) for p in pax["pairs"]]
    if len(numbers) != 2 * count:
        raise ExtractError("a sparse map has another number of fragments")
    return rebuilt(data, list(zip(numbers[::2], numbers[1::2], strict=True)), size, most)


def tar_entries(file: str, gzipped: bool, max_document: int) -> Iterator[tuple[bytes, bool, Callable[[], bytes]]]:
    """Entries in order as (name, regular, read). Data of documents is held as the stream passes it."""
    with open(file, "rb") as raw:
        f = _Gzip(raw) if gzipped else raw

        def take(n: int) -> bytes:
            data = f.read(n)
            if len(data) < n:
                raise ArchiveError("the archive is cut short")
            return data

        def skip(n: int) -> None:
            while n > 0:
                n -= len(take(min(n, 1 << 20)))

        long_name: bytes | None = None
        pax: dict | None = None
        seen_link = False
        while True:
            header = take(BLOCK)
            if not header.strip(b"\0"):
                if take(BLOCK).strip(b"\0"):
                    raise ArchiveError("a zero block inside the archive")
                if gzipped:
                    f.finish_member()
                return
            _checked(header)
            kind = header[156:157]
            empty = kind in b"23456" and kind != b""
            size = number(header[124:136], binary=True)
            if pax and "size" in pax and not empty:
                size = int(pax["size"]) if pax["size"].isdigit() and int(pax["size"]) < 1 << 63 else None
            if empty:
                size = 0
            if size is None:
                raise ArchiveError("a size is not a number")
            padded = -(-size // BLOCK) * BLOCK
            if kind == b"1" and size:
                raise ArchiveError("a hard link with data")
            if kind in (b"L", b"K", b"x", b"X", b"g"):
                if padded > max_document:
                    raise ArchiveError("a name or record is too large")
                data = take(padded)[:size]
                if kind == b"L":
                    if long_name is not None or pax and "path" in pax:
                        raise ArchiveError("two names for one entry")
                    long_name = _text(data)
                elif kind == b"K":
                    if seen_link:
                        raise ArchiveError("two link names for one entry")
                    seen_link = True
                elif kind == b"g":
                    if len(pax_records(data)) > 1 or pax_records(data)["pairs"]:
                        raise ArchiveError("a global header that names an entry")
                else:
                    if pax is not None:
                        raise ArchiveError("two PAX headers for one entry")
                    pax = pax_records(data)
                    if long_name is not None and "path" in pax:
                        raise ArchiveError("two names for one entry")
                continue
            name = _text(header[:100])
            if header[257:265] == b"ustar\x0000" and _text(header[345:500]):
                name = _text(header[345:500]) + b"/" + name
            name = long_name if long_name is not None else name
            sparse = pax is not None and (any(k.startswith("GNU.sparse.") for k in pax) or bool(pax["pairs"]))
            if pax and "path" in pax:
                name = pax["path"]
            if sparse:
                real = pax.get("GNU.sparse.name")
                if real == b"" or real is None and ("GNU.sparse.map" in pax or "GNU.sparse.major" in pax):
                    raise ArchiveError("a sparse entry without its name")
                name = real if real is not None else name
            regular = kind in (b"0", b"\0", b"7", b"S")
            fragments: list[tuple[int, int]] | None = None
            real_size = 0
            if kind == b"S":
                fragments, real_size = _old_sparse(header, take)
            wanted = regular and classify_name(name)[0] == "document"
            if wanted and size <= max_document:
                data = take(padded)[:size]
                yield name, True, _tar_reader(data, fragments, real_size, pax if sparse else None, max_document)
            else:
                skip(padded)
                yield name, regular, _failing("the document is too large")
            long_name, pax, seen_link = None, None, False


def _old_sparse(header: bytes, take: Callable[[int], bytes]) -> tuple[list[tuple[int, int]] | None, int]:
    """The old GNU map, from the header and its extension blocks; None if it holds what is no number."""
    pairs, broken = [], False
    real = number(header[483:495], binary=True)

    def read(block: bytes, count: int) -> None:
        nonlocal broken
        for k in range(count):
            field = block[k * 24 : k * 24 + 24]
            if not field.strip(b"\0"):
                break
            offset, length = number(field[:12], binary=True), number(field[12:], binary=True)
            if offset is None or length is None:
                broken = True
            elif length or offset:
                pairs.append((offset, length))

    read(header[386:482], 4)
    more = header[482]
    while more:
        block = take(BLOCK)
        read(block, 21)
        more = block[504]
    return (None if broken or real is None else pairs), real or 0


def _tar_reader(data: bytes, fragments: list[tuple[int, int]] | None, size: int, pax: dict | None, most: int) -> Callable[[], bytes]:
    def read() -> bytes:
        if pax is not None:
            return _pax_sparse(pax, data, most)
        if fragments is not None:
            return rebuilt(data, fragments, size, most)
        return data

    return read


def _failing(why: str) -> Callable[[], bytes]:
    def read() -> bytes:
        raise ExtractError(why)

    return read
