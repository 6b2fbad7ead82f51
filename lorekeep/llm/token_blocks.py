"""Token ids in patched frame-of-reference blocks.

A file is a run of frames, each ended by a line feed. A frame starts with its kind and sizes:

- ``I``: up to FRAME ids in blocks of BLOCK. Of each block the least id is subtracted, the rest is packed at
  the width that holds a given percentile, and the ids that need more go to an exception list (place and
  value). The frame has an index: each block's least id, width, start of its packed words and of its exceptions.
- ``D``: doc_ids (with a flag for null) and numbers of ids of the documents that end in the frames before it.
- ``X``: the last; the file's number in the order of doc_ids, its ids, and the byte at which each frame starts.

Spark's text writer stores the frames, so files are committed whole, on any file system that Spark writes.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm.shared import materialize, partitions_for, scratch_path, ship

BLOCK, FRAME, LANES = 1024, 1 << 20, 64
#: Share of a block's ids, in per cent, that its width must hold.
PERCENTILE = 95
#: Texts of these characters alone have the same classes in every Unicode table.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")
#: Letters and digits among them.
LETTER, DIGIT = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: How the byte-level vocabulary cuts a text before it merges bytes (a fixed rule of the public format).
PIECES = re.compile(rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+")
#: Bytes of text a file holds, about: there are as many ranges as that asks for.
FILE = 1 << 28
#: Pieces remembered, and the longest that is.
REMEMBERED, LONGEST = 600_000, 48


class PieceEncoder:
    """Ids of whole texts, as little-endian bytes. Pieces are merged each for itself, so known ones are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # Pieces are known to be those of a byte-level cut without a normalizer; of any other file all texts are encoded whole.
        told = json.loads(self.tokenizer.to_str())
        cut = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        # Whatever stands outside the plain rules (added tokens) is left to the tokenizer.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.cuts or not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        pieces = PIECES.findall(text)
        parts = list(map(self.known.get, pieces))
        try:
            return b"".join(parts)
        except TypeError:  # some are new
            where = [k for k, ids in enumerate(parts) if ids is None]
        new = list(dict.fromkeys([pieces[k] for k in where]))
        found = dict(zip(new, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)], strict=True))
        for k in where:
            parts[k] = found[pieces[k]]
        if len(self.known) < REMEMBERED:  # frequent pieces come early
            self.known.update((p, ids) for p, ids in found.items() if len(p) <= LONGEST)
        return b"".join(parts)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(groups, LANES) values below 2^width as (groups, width) 64-bit words."""
    words = np.zeros((len(values), max(width, 1)), np.uint64)
    for j in range(LANES if width else 0):
        at, shift = divmod(j * width, 64)
        words[:, at] |= values[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= values[:, j] >> np.uint64(64 - shift)
    return words[:, :width]


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    values = np.zeros((len(words), LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(LANES if width else 0):
        at, shift = divmod(j * width, 64)
        part = words[:, at] >> np.uint64(shift)
        if shift + width > 64:
            part = part | words[:, at + 1] << np.uint64(64 - shift)
        values[:, j] = part & mask
    return values


def encode_ids(ids: np.ndarray) -> bytes:
    """An ``I`` frame without its kind."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    full = np.resize(ids, blocks * BLOCK).astype(np.uint64) if n else np.empty(0, np.uint64)
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1, initial=np.iinfo(np.uint64).max)
    rest = full - least[:, None]
    place = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    widths = np.ceil(np.log2(np.partition(rest, place, axis=1)[:, place].astype(np.float64) + 1)).astype(np.uint8) if blocks else np.empty(0, np.uint8)
    over = rest >> widths[:, None].astype(np.uint64) > 0
    block, where = np.nonzero(over)
    values = rest[block, where].astype("<u4")
    rest[over] = 0
    sizes = widths.astype(np.uint32) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    body = np.zeros(int(starts[-1]), np.uint8)
    for width in np.unique(widths[widths > 0]):
        same = np.flatnonzero(widths == width)
        packed = pack(rest[same].reshape(-1, LANES), int(width)).astype("<u8").view(np.uint8).reshape(len(same), -1)
        body[starts[same][:, None] + np.arange(packed.shape[1])] = packed
    from_exception = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))]).astype("<u4")
    head = struct.pack("<III", n, blocks, len(values))
    return b"".join([head, least.astype("<u4").tobytes(), widths.tobytes(), starts.tobytes(), from_exception.tobytes(), body.tobytes(), where.astype("<u2").tobytes(), values.tobytes()])


def decode_ids(frame: memoryview, blocks: slice = slice(None)) -> tuple[np.ndarray, int]:
    """The ids of a frame (or of a slice of its blocks) and the frame's length in bytes."""
    n, count, exceptions = struct.unpack_from("<III", frame)
    at = 12

    def take(kind: str, size: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(frame, kind, size, at)
        at += found.nbytes
        return found

    least, widths, starts, begins = take("<u4", count), take("u1", count), take("<u4", count + 1), take("<u4", count + 1)
    body = take("u1", int(starts[-1]))
    where, values = take("<u2", exceptions), take("<u4", exceptions)
    wanted = np.arange(count)[blocks]
    out = np.zeros((len(wanted), BLOCK), np.uint64)
    for width in np.unique(widths[wanted]):
        same = np.flatnonzero(widths[wanted] == width)
        if width:
            size = int(width) * BLOCK // 8
            packed = body[starts[wanted[same]][:, None] + np.arange(size)]
            out[same] = unpack(np.ascontiguousarray(packed).view("<u8").reshape(-1, int(width)), int(width)).reshape(len(same), BLOCK)
    counts = np.diff(begins)[wanted]
    of = np.repeat(np.arange(len(wanted)), counts)
    which = np.concatenate([np.arange(begins[w], begins[w + 1]) for w in wanted[counts > 0]]) if counts.any() else np.empty(0, np.int64)
    out[of, where[which]] = values[which]
    out += least[wanted][:, None]
    flat = out.reshape(-1)
    stop = min(n, (wanted[-1] + 1) * BLOCK) - wanted[0] * BLOCK if len(wanted) else 0
    return flat[:stop].astype("<u4"), at


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2) -> None:
    """Encode doc_id, text and write the ids, in ascending doc_id (null first; ties by the text's hash), one file a range."""
    ship(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(partitions_for(docs.sparkSession), -(-size // FILE))
    ranged = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        size = total = written = 0  # written: since the documents already listed
        ids: list[int | None] = []
        counts: list[int] = []

        def flush() -> Iterator[bytes]:
            nonlocal held, size, written
            joined = np.frombuffer(b"".join(held), "<u4")
            whole = len(joined) if final else len(joined) // BLOCK * BLOCK
            for k in range(0, whole, FRAME):
                yield b"I" + encode_ids(joined[k : min(k + FRAME, whole)])
            held, size = [joined[whole:].tobytes()], len(joined) - whole
            written += whole

        def listed() -> Iterator[bytes]:
            """The documents whose ids are all written; those with ids held back stay for the next list."""
            nonlocal ids, counts, written
            ends = np.cumsum(counts)
            n = int(np.searchsorted(ends, written, "right"))
            if n:
                known = np.array([i is not None for i in ids[:n]], np.uint8)
                yield b"D" + struct.pack("<I", n) + np.array([i or 0 for i in ids[:n]], "<i8").tobytes() + known.tobytes() + np.array(counts[:n], "<u8").tobytes()
                ids, counts, written = ids[n:], counts[n:], written - int(ends[n - 1])

        final = False
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = encode(text.as_py()) + end
                held.append(found)
                size += len(found) // 4
                total += len(found) // 4
                ids.append(i)
                counts.append(len(found) // 4)
                if size >= FRAME:
                    yield from flush()
                    yield from listed()
        final = True
        if total:
            yield from flush()
            yield from listed()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts, total = 0, [], 0
        for frame in frames(batches):
            starts.append(at)
            at += len(frame) + 1
            if frame[:1] == b"I":
                total += struct.unpack_from("<I", frame, 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["value"])
        if starts:
            last = b"X" + struct.pack("<IQI", TaskContext.get().partitionId(), total, len(starts)) + np.array(starts, "<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary())], ["value"])

    ranged.mapInArrow(rows, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 0).option("compression", "none").text(path)


def parse(content: bytes) -> Iterator[tuple[int, int | None, int, int, np.ndarray]]:
    """(file number, doc_id, start in the file, ids, array of ids) for every document of a file."""
    view = memoryview(content)
    (tail,) = struct.unpack_from("<I", content, _last(content) + 1)
    at = start = 0
    parts: list[np.ndarray] = []
    while at < len(view):
        kind, at = view[at : at + 1].tobytes(), at + 1
        if kind == b"I":
            found, size = decode_ids(view[at:])
            parts.append(found)
        elif kind == b"D":
            (n,) = struct.unpack_from("<I", view, at)
            ids, known, counts = np.frombuffer(view, "<i8", n, at + 4), np.frombuffer(view, "u1", n, at + 4 + 8 * n), np.frombuffer(view, "<u8", n, at + 4 + 9 * n)
            size, joined, begin = 4 + 17 * n, np.concatenate(parts), 0
            # The ids of the last document may end in frames that follow; it is listed when they are all there.
            for i, k, c in zip(ids.tolist(), known.tolist(), counts.tolist(), strict=True):
                if begin + c > len(joined):
                    raise ValueError(f"document {i if k else None} is listed before its ids")
                yield tail, i if k else None, start, c, joined[begin : begin + c]
                start, begin = start + c, begin + c
            parts = [joined[begin:]]
        else:
            size = 16 + 8 * struct.unpack_from("<I", view, at + 12)[0]
        at += size + 1


def _last(content: bytes) -> int:
    """Where the index frame starts: it ends the file and says how many frames stand before it."""
    for n in range((len(content) - 18) // 8 + 1):
        at = len(content) - 18 - 8 * n
        if content[at : at + 1] == b"X" and struct.unpack_from("<I", content, at + 13)[0] == n and (not n or struct.unpack_from("<Q", content, at + 17)[0] == 0 and struct.unpack_from("<Q", content, at + 17 + 8 * (n - 1))[0] < at):
            return at
    raise ValueError("no index frame")


def read_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files under path; docs lends its session."""
    spark = docs.sparkSession
    ship(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = [(part, i, start, n, zlib.crc32(ids.tobytes())) for part, i, start, n, ids in parse(content.as_buffer().to_pybytes())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(5)], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    found = materialize(files.mapInArrow(rows, "part long, doc_id long, at long, n_tokens long, ids_crc32 long"), "tokens")
    ahead, total = [], 0
    for r in sorted(found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # one row a file
        ahead.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(ahead or [(0, 0)], "part long, ahead long")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as token files in the shared folder and return what is read back from them.

    A null or empty text is its end id alone. Null doc_ids come first; repeated rows are each written, ordered
    by their text's hash. Empty table: no files, empty result. Other columns are not read.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return read_tokens(docs, path)
