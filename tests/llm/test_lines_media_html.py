import hashlib
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import html, lines, media


def plain_clean(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, source in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\r")
            if key:
                sites[key].add(source or "")
                order = (i is None, i if i is not None else 0)
                first[key] = min(first.get(key, order), order)
    bad = {k for k, s in sites.items() if len(s) >= least}
    out = []
    for i, text, _ in rows:
        me = (i is None, i if i is not None else 0)
        keep = None if text is None else [x for x in text.split("\n") if x.strip(" \t\r") not in bad or first[x.strip(" \t\r")] == me]
        out.append((i, None if keep is None else "\n".join(keep)))
    return out


@pytest.mark.parametrize("least", [2, 6, 40])
def test_line_dedup(docs, least):
    rng = random.Random(least)
    pool = [f"line {i} of the pool" for i in range(60)] + ["", "  ", "x\r", "\ttab"]
    rows = [(i, "\n".join(rng.choice(pool[: 5 + i % 60]) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randint(0, 9))), f"s{rng.randint(0, 50)}") for i in range(400)]
    got = sorted((r.doc_id, r.text) for r in lines.without_boilerplate(docs(rows), least).collect())
    assert got == sorted(plain_clean(rows, least))


def test_lines_against_sql(sample):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    docs = sample("documents", "sf0.01")
    out = lines.cleaned(docs)
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())
    assert got == sorted(con.execute(lines.SQL).fetchall()) and sum(r[3] for r in got) > 100


def test_lines_of_awkward_rows(awkward, docs):
    out = lines.without_boilerplate(awkward, 2)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == [None] and texts[2] == [""] and texts[5] == ["same text here for all"] and texts[6] == ["", ""] and texts[None] == [""] and texts[3] == ["  \n\t "]
    assert lines.without_boilerplate(awkward.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
    long = "\n".join(f"l{i}" for i in range(30_000))
    two = lines.without_boilerplate(docs([(1, long, "a"), (2, long + "\nown", "b")]), 2)
    assert {r.doc_id: r.text for r in two.collect()} == {1: long, 2: "own"}


def test_sketches_merge(docs):
    a, b = (lines.site_sketches(lines.line_table(docs([(i, "x\ny", f"{s}{i}") for i in range(10)]))) for s in "pq")
    from pyspark.sql import functions as F

    assert {r[0] for r in lines.merged_sketches(a, b).select(F.hll_sketch_estimate("sketch")).collect()} == {20}


# GIF


def test_texts_come_back(awkward):
    got = media.media_digests(awkward).collect()
    want = []
    for r in awkward.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        gif, _ = media.stored(r.text)
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(gif), hashlib.sha256(gif).hexdigest()))
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert len({r.feature for r in got if r.doc_id in (5, 6)}) == 1 and media.media_digests(awkward.limit(0)).count() == 0
    assert media.frames(media.text_media(awkward)).where("frame = 0").count() == awkward.count()
    assert media.frames(media.text_media(awkward).selectExpr("media_id", "cast(null as binary) as media")).count() == 0


def compress(samples, size, clear_at=4096):
    """Dictionary codes as any encoder writes them."""
    clear, out, bits, held = 1 << size, bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(clear)}, size + 1
    fresh, n = dict(table), clear + 2

    def put(code):
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(clear)
    word = b""
    for s in samples:
        more = word + bytes([s])
        if more in table:
            word = more
            continue
        put(table[word])
        if n < clear_at:
            table[more] = n
            if n == 1 << width and width < 12:
                width += 1
            n += 1
        else:
            put(clear)
            table, width, n = dict(fresh), size + 1, clear + 2
        word = bytes([s])
    if word:
        put(table[word])
    put(clear + 1)
    if bits:
        out.append(held & 255)
    return bytes(out)


@given(st.integers(2, 8), st.binary(min_size=1, max_size=6000), st.sampled_from([600, 4096]))
@settings(max_examples=60, deadline=None)
def test_streams_of_any_encoder(size, data, clear_at):
    samples = (np.frombuffer(data, np.uint8).astype(int) % (1 << size)).astype(np.uint8)
    assert (media.lzw(compress(samples.tolist(), size, clear_at), size, len(samples)) == samples).all()


def test_long_runs_and_full_dictionaries():
    rng = np.random.default_rng(1)
    for samples in (np.zeros(50_000, np.uint8), rng.integers(0, 256, 60_000).astype(np.uint8)):
        assert (media.lzw(compress(samples.tolist(), 8), 8, len(samples)) == samples).all()
        assert (media.lzw(media.packed_codes(media.code_stream(samples.tobytes())), 8, len(samples)) == samples).all()


def picture(w, h, parts, palette=b"\0\0\0\xff\0\0\0\xff\0\0\0\xff"):
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette
    for left, top, samples, delay, disposal, clear, local, flags in parts:
        samples = np.array(samples, np.uint8)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += b"\x21\xfe\x03abc\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, samples.shape[1], samples.shape[0], flags | (0x81 if local else 0)) + (local or b"")
        out += b"\x02" + media.blocks_of(compress(samples.ravel().tolist(), 2))
    return out + b"\x3b"


def test_transparency_disposal_and_palettes():
    gif = media.decode(picture(2, 2, [
        (0, 0, [[1, 1], [1, 1]], 5, 1, None, None, 0),
        (0, 0, [[2, 0], [0, 2]], 7, 3, 0, None, 0),
        (1, 1, [[3]], 9, 2, None, None, 0),
        (0, 1, [[1]], 1, 0, None, b"\x09\x09\x09\x08\x08\x08\x07\x07\x07\x06\x06\x06", 0),
    ]))
    red, green, blue, grey, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [8, 8, 8, 255], [0, 0, 0, 0]
    shown = [(t, d, c.tolist()) for t, d, c in media.composed(gif)]
    assert shown == [(0, 5, [[red, red], [red, red]]), (5, 7, [[green, red], [red, green]]), (12, 9, [[red, red], [red, blue]]), (21, 1, [[red, red], [grey, none]])]
    assert media.histogram(np.array(shown[0][2], np.uint8)).tolist() == [0] * 7 + [4] + [4] + [0] * 7 + [4] + [0] * 7
    rows = np.arange(10)[:, None] % 4
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    assert (media.decode(picture(1, 10, [(0, 0, rows[order], 0, 0, None, None, 0x40)])).frames[0].samples == rows).all()


def test_broken_files():
    whole = picture(2, 2, [(0, 0, [[1, 2], [3, 0]], 5, 1, None, None, 0)] * 2)
    for cut in range(13, len(whole)):
        gif = media.decode(whole[:cut])
        assert gif.truncated and len(gif.frames) <= 2
    with pytest.raises(ValueError):
        media.decode(b"PNG")


def test_frames_table(spark):
    data = picture(2, 1, [(0, 0, [[1, 2]], 5, 1, None, None, 0), (0, 0, [[3, 3]], 6, 1, None, None, 0)])
    rows = media.frames(spark.createDataFrame([(1, bytearray(data)), (2, None)], "media_id bigint, media binary")).orderBy("frame").collect()
    assert [(r.media_id, r.start_cs, r.delay_cs, sum(r.red), r.blue[7]) for r in rows] == [(1, 0, 5, 2, 0), (1, 5, 6, 2, 2)]


# HTML


@pytest.mark.parametrize("page, text", [
    ("<p>a<p>b<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>z", "a\n\nb\n\n- x\n- y\n  3. q\n  4. r\n\nz"),
    ("<table><tr><td>ab<td>c<tr><td>longer<td>d</table>tail", "ab      c\nlonger  d\n\ntail"),
    ("<table><caption>Cap</caption><tr><th rowspan=2>A</th><th colspan=2>BC</th></tr><tr><td>1</td><td>2</td></tr><tr><td>xxxx<td>yy<td>zz</table>", "Cap\nA     BC\n      1   2\nxxxx  yy  zz"),
    ("<title>t</title><script>if (a<b) x()</script>v<style>p{}</style><!-- c --><template>t</template> w", "v w"),
    ("<style>.h,p.g{display:none}#q{visibility:hidden}</style><p class='h'>no<p class=g>no<div class=g>yes</div><span id=q>no <b style='visibility:visible'>seen</b></span>", "yes\nseen"),
    ("<div hidden>no</div><p style='DISPLAY : none'>no</p>yes<input type=hidden value=no>", "yes"),
    ("<pre>\n a  b\n  c</pre><dl><dt>T<dd>D</dl>", " a  b\n  c\n\nT\n  D"),
    ("<select><option>1<option selected>2</select><details>no<summary>sum</summary></details><details open><summary>s</summary>d</details>", "2\nsum\ns\nd"),
    ("a &amp; b&nbsp;c &lt;br&gt;<br><br>d", "a & b c <br>\n\nd"),
    ("<b>bo<i>th</b> on</i>e  line\n here", "both one line here"),
    ("x <a href='unclosed>y", "x"), ("a<!-- c", "a"), ("", ""), (None, ""), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("</p>x</td></table></div>", "x"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
])
def test_layout(page, text):
    assert html.page_text(page)[1] == text


def test_deep_pages_and_many_tags():
    assert html.page_text("<div>" * 50_000 + "deep")[1] == "deep"
    assert html.page_text("<b " * 20_000 + "x")[1] == ""
    assert html.page_text("<" * 20_000)[1] == "<" * 20_000
    assert len(html.page_text("<p>x" * 20_000)[1]) == 3 * 20_000 - 2


@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td colspan=3>", "</td>", "</table>", "<li>", "<ul>", "</ul>", "text ", "<br>", "<pre>", "</pre>", "<", "&", "<!--", "-->", "<script>", "</script>", '"', "<a b='", "<select>", "<option>", "\n"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_page_gives_a_text(parts):
    html.page_text("".join(parts))


def test_pages(sample, spark):
    pages = sample("pages")
    rows = html.extracted(pages).collect()
    assert len(rows) == pages.count() and all("<" not in r.text and "track(" not in r.text and r.title for r in rows)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>x", 2), (None, "u", "<p>x", 2)], "page_id bigint, url string, html string, title int")
    assert sorted(str(r.text) for r in html.extracted(odd).collect()) == ["", "x", "x"] and html.extracted(odd.limit(0)).count() == 0
    assert isinstance(pa.array([r.text for r in rows]), pa.Array)
