"""The count filter of the byte-position index."""

import numpy as np

from ledgerlight.llm.simhash import POSITIONS, linked, survivors, tallied


def test_the_tally_counts_shared_positions_and_drops_pairs_before_they_are_verified(monkeypatch):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 300, np.uint64)
    fp[:] = fp & np.uint64(~0xFFFFFF & (1 << 64) - 1) | np.uint64(0x123456)  # one list: three bytes in common
    fp[1] = fp[0] ^ np.uint64(1 << 40)
    fp[3] = fp[2] ^ np.uint64(0b1111 << 56)
    fp[5] = fp[4] ^ np.uint64(0b11111 << 56)
    bytes_ = np.ascontiguousarray(fp.astype("<u8").view(np.uint8).reshape(-1, POSITIONS).T)
    a, b = np.triu_indices(len(fp), 1)
    plain = [sum(x == y for x, y in zip(int(fp[i]).to_bytes(8, "little"), int(fp[j]).to_bytes(8, "little"), strict=True)) for i, j in zip(a, b, strict=True)]
    assert tallied(bytes_, a, b).tolist() == plain
    assert sum(x < 4 for x in plain) > 0.9 * len(plain)  # pruned by the tally
    verified = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: verified.append(len(x)) or count(x))
    u, v = survivors(fp, bytes_, a, b, 4)
    assert sum(verified) == sum(x >= 4 for x in plain)
    assert list(zip(u.tolist(), v.tolist(), strict=True)) == [(0, 1), (2, 3)]
    one, other = linked(np.zeros(len(fp), int), fp, 4)
    assert {frozenset(p) for p in zip(one.tolist(), other.tolist(), strict=True)} == {frozenset((int(fp[0]), int(fp[1]))), frozenset((int(fp[2]), int(fp[3])))}
