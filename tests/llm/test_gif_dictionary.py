"""The dictionary of the GIF's code streams, and the query's columns against a plain reading."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import media


def plain_lzw(data, size):
    """Codes one by one through a dictionary, as the format describes them; the samples, and the codes that were read."""
    clear, bits, held, at, out, seen = 1 << size, 0, 0, 0, [], []
    table, width, before = None, size + 1, None
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out), seen
            held, bits, at = held | data[at] << bits, bits + 8, at + 1
        code, held, bits = held & (1 << width) - 1, held >> width, bits - width
        seen.append(code)
        if code == clear + 1:
            return b"".join(out), seen
        if code == clear or table is None:
            table, width, before = {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}, size + 1, None
            if code == clear:
                continue
        entry = table[code] if code in table else before + before[:1]
        if before is not None and len(table) < 4096:
            table[len(table)] = before + entry[:1]
            if len(table) == 1 << width and width < 12:
                width += 1
        before = entry
        out.append(entry)


@given(st.one_of(st.binary(max_size=9000), st.text("ab \n", max_size=30_000).map(str.encode), st.integers(0, 40_000).map(bytes)))
@settings(max_examples=40, deadline=None)
def test_streams_grow_and_clear_a_dictionary(data):
    stream = media.packed_codes(media.code_stream(data))
    samples, seen = plain_lzw(stream, 8)
    assert samples == data and (media.lzw(stream, 8, len(data)) == np.frombuffer(data, np.uint8)).all()
    assert len(data) < 600 or len(set(data)) > 40 or max(seen) > 257


def test_texts_use_the_dictionary_and_shrink():
    text = "the quick brown fox jumps over the lazy dog, and the dog sleeps on. " * 2000
    gif, n = media.stored(text)
    assert len(gif) < n / 3
    stream = media.packed_codes(media.code_stream(text.encode()))
    _, seen = plain_lzw(stream, 8)
    assert max(seen) > 4000 and sum(c > 257 for c in seen) > 0.8 * len(seen)
    noise = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes()
    assert plain_lzw(media.packed_codes(media.code_stream(noise)), 8)[1].count(256) > 5  # full, cleared and grown again


def test_digests_against_a_plain_reading():
    texts = [None, "", "a", "x" * 64, "é漢 \n" * 40_000, "words and words " * 900]
    rows = next(media.digests(iter([pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})]))).to_pylist()
    for text, row in zip(texts, rows, strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        rows_ = len(payload) // 64
        frames = -(-rows_ // media.ROWS)
        grey = [sum(b >> 5 == k for b in payload) for k in range(8)]
        stored, _ = media.stored(text)
        assert row["feature"] == f"frames={frames};cs={media.DELAY * frames};grey={','.join(map(str, grey))}"
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(raw), len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]))
        assert (row["media_bytes"], row["media_sha256"]) == (len(stored), sha256(stored).hexdigest())
