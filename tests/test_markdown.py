"""Chunks of Markdown, by construct of CommonMark; bodies worked out by hand, ranges by what they must tile."""

import random

import pytest

from lorekeep.operators.markdown import chunk_markdown, markdown_chunks

LOG = """Harbour log of the *Petrel*, kept by the mate.

Departure
=========

Cast off at **05:10** with `gps` running, see [the chart](charts/7.png "sheet 7").

Stores
------

1. rope, 40 m
2. lamp oil
   - two tins
   - a funnel
3. flour

> The pilot wrote: *mind the bar*.
>
> He did not sign.

### Signals &amp; lights

    green over white
    red

Nothing else.
"""


def bodies(source):
    return [c.body for c in chunk_markdown(source)]


def spans(source):
    raw = source.encode()
    return [raw[c.start : c.end].decode() for c in chunk_markdown(source)]


def prose(words, of="tide"):
    return " ".join(f"{of}{k}" for k in range(words))


def check_tiling(source):
    """Ranges cover the document without gaps, start on characters, and never go back."""
    found, size = chunk_markdown(source), len(source.encode())
    assert (found[0].start, found[-1].end) == (0, size)
    for k, c in enumerate(found):
        assert 0 <= c.start <= c.end <= size
        source.encode()[c.start : c.end].decode()
        if k:
            assert found[k - 1].start <= c.start <= found[k - 1].end


def test_a_document_of_many_constructs():
    assert bodies(LOG) == [
        "Harbour log of the Petrel, kept by the mate.",
        "Departure\n\nCast off at 05:10 with gps running, see the chart.",
        "Stores\n\nrope, 40 m\n\nlamp oil\n\ntwo tins\n\na funnel\n\nflour\n\nThe pilot wrote: mind the bar.\n\nHe did not sign.",
        "Signals & lights\n\ngreen over white\nred\n\nNothing else.",
    ]
    heads = ["Harbour", "Departure\n=", "Stores\n-", "### Signals"]
    assert [s.startswith(h) for s, h in zip(spans(LOG), heads, strict=True)] == [True] * 4 and "".join(spans(LOG)) == LOG


@pytest.mark.parametrize(
    ("inline", "text"),
    [
        ("__strong__ and _weak_ words", "strong and weak words"), ("3 \\* 4 \\_ 5", "3 * 4 _ 5"), ("`` a`b ``", "a`b"), ("mail <me@port.example>", "mail me@port.example"),
        ("![the quay](quay.png) at dawn", "the quay at dawn"), ("[deep][d] water\n\n[d]: /depth", "deep water"), ("north&nbsp;east &lt;5 &#65;", "north\xa0east <5 A"), ("x <em>y</em> z", "x y z"),
        ("line one\\\nline two", "line one\nline two"), ("file_name_here 2*3*4", "file_name_here 234"),
    ],
)
def test_inlines(inline, text):
    assert bodies(inline) == [text]


@pytest.mark.parametrize(
    ("block", "text"),
    [
        ("~~~ sh\nls # here\n\npwd\n~~~", "ls # here\n\npwd"), ("+ one\n\n+ two", "one\n\ntwo"), ("* a\n  b\n* c", "a\nb\n\nc"), ("10) ten\n11) eleven", "ten\n\neleven"),
        ("> quoted\nlazy", "quoted\nlazy"), ("before\n\n***\n\nafter", "before\n\nafter"), ("<table>\n<tr><td>cell</td></tr>\n</table>\n\nafter", "after"), ("\tcode by tab", "code by tab"),
    ],
)
def test_blocks(block, text):
    assert bodies(block) == [text]


@pytest.mark.parametrize(("heading", "text"), [("####### seven", None), ("#tag", None), ("## closed ##", "closed"), ("   ### set in", "set in"), ("###### *six*", "six"), ("Two lines\nof title\n---", "Two lines\nof title")])
def test_what_is_a_heading(heading, text):
    found = bodies(f"Lead.\n\n{heading}\n\nRest.\n")
    assert found == ([f"Lead.\n\n{heading}\n\nRest."] if text is None else ["Lead.", f"{text}\n\nRest."])


@pytest.mark.parametrize("source", ["\n\n \t\n", "<!-- nothing shown -->\n", "[only]: /a-definition\n", "---\nkey: value\n...\n", "***\n"])
def test_without_text_there_is_one_empty_chunk(source):
    assert [(c.body, c.start, c.end) for c in chunk_markdown(source)] == [("", 0, len(source))]


def test_front_matter_counts_only_where_it_is_closed_at_the_top():
    assert bodies("---\nlang: en\n---\nPort and starboard.\n") == ["Port and starboard."]
    assert "lang: en" in " ".join(bodies("Lead.\n\n---\nlang: en\n---\nPort.\n"))
    assert "lang: en" in " ".join(bodies("---\nlang: en\n\nPort.\n"))


def test_sections_fill_chunks_without_splitting_blocks_that_fit():
    a, b, c = prose(40, "ebb"), prose(60, "flood"), prose(50, "slack")
    source = f"## Tides\n\n{a}\n\n{b}\n\n{c}\n"
    found = bodies(source)
    assert found == [f"Tides\n\n{a}\n\n{b}", c] if len(f"Tides\n\n{a}\n\n{b}") <= 700 else [f"Tides\n\n{a}", f"{b}\n\n{c}"]
    assert "".join(spans(source)) == source
    short = "\n\n".join(f"## Part {k}\n\nshort" for k in range(5))
    assert bodies(short) == [f"Part {k}\n\nshort" for k in range(5)]


def test_blocks_above_the_window_are_cut_with_overlap():
    for source, text in ((f"{prose(400)}\n", prose(400)), ("```\n" + "\n".join(prose(12, f"r{k}_") for k in range(30)) + "\n```\n", "\n".join(prose(12, f"r{k}_") for k in range(30)))):
        found = bodies(source)
        assert len(found) > 2 and all(len(x) <= 700 for x in found)
        joined = found[0]
        for x in found[1:]:
            assert joined.endswith(x[:70])
            joined += x[70:]
        assert joined == text
        check_tiling(source)


def test_windows_count_characters_and_ranges_bytes():
    source = "潮汐表" * 300
    found = chunk_markdown(source)
    assert [len(c.body) for c in found] == [700, 270] and found[-1].end == 2700
    check_tiling(source)


@pytest.mark.parametrize("tail", ["![](wreck.png)\n", "<hr class=x>\n", "[r]: /ref 'title'\n", "___\n"])
def test_what_shows_nothing_belongs_to_the_section_it_ends(tail):
    first, second = f"## Wrecks\n\nTwo.\n\n{tail}\n", "## Lights\n\nOne.\n"
    assert spans(first + second) == [first, second]


def test_a_heading_inside_a_quote_opens_a_section():
    assert spans("Lead.\n\n> ## Notice\n> closed\n\nRest.\n") == ["Lead.\n\n", "> ## Notice\n> closed\n\nRest.\n"]


def test_line_ends_of_all_kinds():
    for end in ("\n", "\r\n", "\r"):
        source = LOG.replace("\n", end)
        check_tiling(source)
        assert [" ".join(b.split()) for b in bodies(source)] == [" ".join(b.split()) for b in bodies(LOG)]


def test_generated_documents_are_tiled_and_lose_no_word():
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(10**6)}"
    makers = [
        lambda: f"{'#' * rng.randint(1, 6)} {word()}", lambda: f"{word()} {word()} é {word()}", lambda: f"- {word()}\n- {word()}\n  - {word()}", lambda: f"> {word()}\n> {word()}",
        lambda: f"```\n{word()}\n\n# {word()}\n```", lambda: f"    {word()}", lambda: f"{rng.randint(1, 99)}. {word()}\n\n   {word()}", lambda: f"{word()}\n{'=' * rng.randint(1, 5)}",
        lambda: " ".join(word() for _ in range(rng.randint(1, 150))), lambda: f"**{word()}** [{word()}](/x) `{word()}`",
    ]
    for _ in range(150):
        parts = [rng.choice(makers)() for _ in range(rng.randint(1, 12))]
        source = "\n\n".join(parts) + "\n" * rng.randint(0, 2)
        check_tiling(source)
        shown = " ".join(bodies(source))
        missing = [w for w in __import__("re").findall(r"w\d+", source) if w not in shown]
        assert not missing, source
    marks = list("#>-*`~=_[]()!<&:\\|+ \t\n") + ["1.", "---", "\r\n", "ñ", "```", "[a]: b", "<b", "word"]
    for _ in range(600):
        check_tiling("".join(rng.choice(marks) for _ in range(rng.randint(0, 60))))


def test_chunks_of_a_table(spark):
    rows = spark.createDataFrame([("log", "p.md", LOG), ("log", "void.md", "")], "collection string, path string, content string")
    found = sorted((r["path"], r["chunk_sequence"], r["body"]) for r in markdown_chunks(rows).collect())
    assert found == [("p.md", k, b) for k, b in enumerate(bodies(LOG))] + [("void.md", 0, "")]
