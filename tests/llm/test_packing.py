import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.llm import packing, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_tokenizer_path())


def plain_ids(tokenizer, text, end=2):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check(tokenizer, docs, rows, capacity=4096):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens, r.start].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for d in docs:
        ids = plain_ids(tokenizer, d.text)
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            want[d.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    for window in windows.values():
        at = 0
        for offset, length in sorted(window):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(windows)) if windows else 1.0


def test_all_documents(sample, tokenizer):
    docs = sample("documents", "sf0.01")
    assert check(tokenizer, docs.collect(), packing.pack(docs).collect()) > 0.99


def test_awkward_rows(awkward, tokenizer):
    check(tokenizer, awkward.collect(), packing.pack(awkward, capacity=512).collect(), 512)
    rows = packing.pack(awkward, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack(awkward.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=7), st.integers(0, 80))
@settings(max_examples=150, deadline=None)
def test_fills_are_the_closest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    fill = packing.best_fill(counts, room)
    assert sum(k * n for k, n in fill.items()) == max(sums) and all(n <= counts[k] for k, n in fill.items())


def test_plans_place_every_piece():
    rng = random.Random(1)
    counts = dict(Counter(rng.randint(1, 100) for _ in range(3000)))
    places, seen, used = packing.plan(counts, 100), Counter(), defaultdict(int)
    for length, first, ranks, each, window, offset in places:
        assert first == seen[length] and ranks % each == 0
        seen[length] += ranks
        for w in range(ranks // each):
            used[window + w] += each * length
    assert seen == Counter(counts) and max(used.values()) <= 100
    assert sum(used.values()) / (100 * len(used)) > 0.98


def test_words_are_encoded_as_in_their_texts(tokenizer):
    known, rng = tokens.WordIds(tokens.word_tokenizer_path()), random.Random(2)
    signs = [*"abcXYZ'stremd019.,!$%|<>_-éÉßÿ×÷ªµ \t\n\x0b\x1c\x85\xa0　İiſKJ̌́ΣσςА漢😀‍\x00", "<|endoftext|>", "'s", "'ll", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert known.encode(text) == plain_ids(tokenizer, text)[:-1].tobytes(), text
