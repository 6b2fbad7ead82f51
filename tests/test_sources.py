import gzip
import io
import os
import struct
import tarfile
import zipfile
import zlib

import pytest

from lorekeep.errors import ArchiveError, ExtractError
from lorekeep.sources import archives, walker
from lorekeep.sources.extract import extract


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def walked(root):
    return [p for p, _ in walker.walk(str(root))]


def test_walk_takes_documents_of_any_case_and_hidden_ones(tmp_path):
    tree(tmp_path, {"a.md": "", "B.PDF": "", "c.MarkDown": "", "d.txt": "", ".md": "", ".hidden/e.md": "", "_f.md": "", "sub.md/g.md": ""})
    assert walked(tmp_path) == [".hidden/e.md", "B.PDF", "_f.md", "a.md", "c.MarkDown", "sub.md/g.md"]


def test_ignore_files_count_in_repositories_only(tmp_path):
    files = {".gitignore": "build/\n*.tmp.md\n!keep.tmp.md\n/top.md\n", "a.md": "", "x.tmp.md": "", "keep.tmp.md": "", "top.md": "", "sub/top.md": "", "build/b.md": "", "sub/.gitignore": "own*\n", "sub/own.md": ""}
    tree(tmp_path, files)
    assert len(walked(tmp_path)) == 7
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/in.md").write_text("")
    assert walked(tmp_path) == ["a.md", "keep.tmp.md", "sub/top.md"]
    assert walked(tmp_path / "sub") == ["top.md"]
    assert walked(tmp_path / "build") == ["b.md"]  # a root is never left out
    tree(tmp_path, {".gitignore": "**/deep/*.md\ndocs/**/x.md\n"})
    tree(tmp_path, {"p/deep/a.md": "", "docs/x.md": "", "docs/q/r/x.md": "", "docs/y.md": ""})
    assert "docs/y.md" in walked(tmp_path) and not {"p/deep/a.md", "docs/x.md", "docs/q/r/x.md"} & set(walked(tmp_path))


def test_links_are_followed_at_the_root_only(tmp_path):
    tree(tmp_path / "real", {"a.md": "", "d/b.md": ""})
    os.symlink(tmp_path / "real", tmp_path / "link")
    os.symlink(tmp_path / "real/a.md", tmp_path / "real/c.md")
    os.symlink(tmp_path / "real/d", tmp_path / "real/e")
    assert walked(tmp_path / "link") == ["a.md", "d/b.md"] and walked(tmp_path / "none") == []


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"./docs//a.md", ("document", "docs/a.md")), (b"a\\b.md", ("document", "a/b.md")), (b"x.txt", ("ignored", "")), (b"__MACOSX/a.md", ("ignored", "")), (b"d/._a.md", ("ignored", "")),
        (b".md", ("ignored", "")), (b"\xff.png", ("ignored", "")), (b"\xff.md", ("rejected", "name is not UTF-8")), (b"/a.md", ("rejected", "absolute name")), (b"./C:/a.md", ("rejected", "absolute name")),
        (b"a/../b.md", ("rejected", "name leaves the archive")), (b"a\x01.md", ("rejected", "control character in name")), (b"../__MACOSX/a.md", ("rejected", "name leaves the archive")),
    ],
)
def test_entry_names(raw, want):
    assert archives.classify_name(raw) == want


def zipped(path, entries, **more):
    with zipfile.ZipFile(path, "w", **more) as z:
        for n, d in entries:
            z.writestr(n, d)


def read_all(path, **more):
    found = archives.listed(str(path), **more)
    return {p: d.read() for p, d in found.documents.items()}


def test_zip_files(tmp_path):
    path = tmp_path / "a.ZIP"
    zipped(path, [("a.md", "old"), ("b.md", b"x" * 5000), ("d/", "")], compression=zipfile.ZIP_DEFLATED)
    assert read_all(path) == {"a.md": b"old", "b.md": b"x" * 5000}
    with pytest.raises(ExtractError):
        read_all(path, max_document=100)
    with pytest.raises(ArchiveError):
        archives.listed(str(path), max_names=130)
    data = path.read_bytes()
    for broken in (data[:-1], data[:-22], data[10:], data + b"x" * 70000, data.replace(b"PK\3\4", b"PK\3\5", 1)):
        (tmp_path / "b.zip").write_bytes(broken)
        with pytest.raises(ArchiveError):
            archives.listed(str(tmp_path / "b.zip"))


def test_a_damaged_zip_document_fails_alone(tmp_path):
    path = tmp_path / "a.zip"
    zipped(path, [("a.md", "hello hello"), ("b.md", "fine")])
    path.write_bytes(path.read_bytes().replace(b"hello hello", b"hellX hello"))
    found = {p: (d, e) for p, d, e in archives.contents(str(path), {"a.md", "b.md"})}
    assert found["b.md"] == (b"fine", None) and found["a.md"][0] is None


def test_a_second_end_record_in_the_comment_is_refused(tmp_path):
    path = tmp_path / "a.zip"
    zipped(path, [])
    inner = path.read_bytes()
    outer = tmp_path / "b.zip"
    with zipfile.ZipFile(outer, "w") as z:
        z.comment = inner
    data = outer.read_bytes()
    fake = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0, 0, 0, len(data) - len(inner), 0)
    outer.write_bytes(data[: -len(inner)] + fake)
    with pytest.raises(ArchiveError):
        archives.listed(str(outer))


def tarred(path, entries, mode="w", form=tarfile.PAX_FORMAT):
    with tarfile.open(path, mode, format=form) as t:
        for n, d in entries:
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_files(tmp_path, form):
    path = tmp_path / "a.tar"
    name = "d/" * 60 + "é" * 20 + ".md"
    entries = [("a.md", b"old"), ("a.md", b"new"), (name if form != tarfile.USTAR_FORMAT else "d/" * 60 + "e.md", b"y" * 700), ("z.txt", b"no")]
    tarred(path, entries, form=form)
    assert read_all(path) == {"a.md": b"new", entries[2][0]: b"y" * 700}
    data = path.read_bytes().rstrip(b"\0")
    cut = -(-len(data) // 512) * 512
    for broken in (data[:cut], path.read_bytes()[: cut + 512], b"\0" * 512 + path.read_bytes()[512:], path.read_bytes()[:140] + b"9" + path.read_bytes()[141:]):
        (tmp_path / "b.tar").write_bytes(broken)
        with pytest.raises(ArchiveError):
            archives.listed(str(tmp_path / "b.tar"))


def test_gzip_members(tmp_path):
    path = tmp_path / "a.tar"
    tarred(path, [("a.md", b"x" * 3000)])
    raw = path.read_bytes()
    two = gzip.compress(raw[:900]) + gzip.compress(raw[900:])
    for name, data in (("b.tgz", two), ("c.tar.gz", two + b"\0" * 512)):
        (tmp_path / name).write_bytes(data)
        assert read_all(tmp_path / name) == {"a.md": b"x" * 3000}
    bad = bytearray(gzip.compress(raw))
    bad[-6] ^= 1  # the checksum of the member that ends the archive
    for data in (bytes(bad), two[:-20]):
        (tmp_path / "d.tgz").write_bytes(data)
        with pytest.raises(ArchiveError):
            archives.listed(str(tmp_path / "d.tgz"))


def header(name, size, kind=b"0", extra=b""):
    block = bytearray(512)
    block[: len(name)] = name
    block[100:108] = b"0000644\0"
    block[124:136] = f"{size:011o}\0".encode()
    block[156:157] = kind
    block[257:265] = b"ustar  \0" if kind == b"S" else b"ustar\x0000"
    block[386 : 386 + len(extra)] = extra
    block[148:156] = b" " * 8
    block[148:156] = f"{sum(block):06o}\0 ".encode()
    return bytes(block)


def padded(data):
    return data + b"\0" * (-len(data) % 512)


def pax(**records):
    out = b""
    for k, v in records.items():
        body = f" {k.replace('__', '.')}={v}\n".encode()
        n = len(body) + len(str(len(body)))
        n = len(body) + len(str(n))
        out += str(n).encode() + body
    return out


def sparse_file(tmp_path, *parts):
    path = tmp_path / "s.tar"
    path.write_bytes(b"".join(parts) + b"\0" * 1024)
    return path


WANT = b"\0" * 10 + b"abc" + b"\0" * 7 + b"de" + b"\0" * 3


def test_sparse_files_in_all_forms(tmp_path):
    field = lambda n: f"{n:011o}\0".encode()
    old = field(10) + field(3) + field(20) + field(2) + b"\0" * 48 + b"\0" + field(25)
    assert read_all(sparse_file(tmp_path, header(b"a.md", 5, b"S", old), padded(b"abcde"))) == {"a.md": WANT}
    head = lambda records: header(b"x", len(records), b"x") + padded(records)
    one = pax(GNU__sparse__size=25, GNU__sparse__numblocks=2, GNU__sparse__map="10,3,20,2", GNU__sparse__name="a.md")
    assert read_all(sparse_file(tmp_path, head(one), header(b"stand-in", 5), padded(b"abcde"))) == {"a.md": WANT}
    body = padded(b"2\n10\n3\n20\n2\n") + b"abcde"
    new = pax(GNU__sparse__major=1, GNU__sparse__minor=0, GNU__sparse__name="a.md", GNU__sparse__realsize=25)
    assert read_all(sparse_file(tmp_path, head(new), header(b"stand-in", len(body)), padded(body))) == {"a.md": WANT}
    zero = b"".join(pax(**{k: v}) for k, v in (("GNU__sparse__size", 25), ("GNU__sparse__numblocks", 2), ("GNU__sparse__offset", 10), ("GNU__sparse__numbytes", 3), ("GNU__sparse__offset", 20), ("GNU__sparse__numbytes", 2)))
    assert read_all(sparse_file(tmp_path, head(zero), header(b"a.md", 5), padded(b"abcde"))) == {"a.md": WANT}
    short = pax(GNU__sparse__size=25, GNU__sparse__numblocks=2, GNU__sparse__map="20,2,10,3", GNU__sparse__name="a.md")
    with pytest.raises(ExtractError):
        read_all(sparse_file(tmp_path, head(short), header(b"s", 5), padded(b"abcde")))
    with pytest.raises(ArchiveError):
        archives.listed(str(sparse_file(tmp_path, head(pax(GNU__sparse__size=25, GNU__sparse__map="0,1")), header(b"s.md", 5), padded(b"abcde"))))


def test_tar_headers_that_leave_an_entry_unsettled(tmp_path):
    long = header(b"././@LongLink", 5, b"L") + padded(b"a.md\0")
    record = header(b"x", len(pax(path="b.md")), b"x") + padded(pax(path="b.md"))
    entry = header(b"c.md", 1) + padded(b"z")
    assert read_all(sparse_file(tmp_path, long, entry)) == {"a.md": b"z"}
    assert read_all(sparse_file(tmp_path, record, entry)) == {"b.md": b"z"}
    broken = header(b"x", 5, b"x") + padded(b"9 x=y")
    for parts in ((long, long, entry), (long, record, entry), (record, record, entry), (header(b"l.md", 1, b"1"), padded(b"z")), (broken, entry), (header(b"g", len(pax(path="b.md")), b"g") + padded(pax(path="b.md")), entry)):
        with pytest.raises(ArchiveError):
            archives.listed(str(sparse_file(tmp_path, *parts)))


def test_extraction():
    assert extract("é".encode(), "markdown") == "é"
    with pytest.raises(ExtractError):
        extract(b"\xff", "markdown")
    with pytest.raises(ExtractError):
        extract(b"no", "pdf")
    body = zlib.compress(b"BT /F1 12 Tf (Hello \\(wor) Tj (ld\\)) Tj T* [(sec) -300 (ond)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 1 /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF\n"
    assert extract(pdf, "pdf") == "Hello (world)\nsec ond"
