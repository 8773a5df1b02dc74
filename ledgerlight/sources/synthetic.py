"""Made order feeds with the truth about them: seeded, with several symbols in one stream, and a plain book kept beside."""

from __future__ import annotations

import random
import struct
from collections.abc import Iterator

from ledgerlight.sources.itch import FIELDS, LENGTHS

#: Shares of the message types between the session's preamble and its end.
MIX = {"A": 38, "F": 3, "D": 33, "U": 12, "X": 6, "E": 5, "C": 1, "P": 2}
OPEN, STEP = 34_200_000_000_000, 1_000_000
TICK = 100


def message(kind: str, ts: int = 0, locate: int = 1, **values) -> bytes:
    """The bytes of one message; fields that aren't given are zero or blank."""
    out = bytearray(kind.encode() + struct.pack(">HH", locate, 0) + ts.to_bytes(6, "big") + b" " * (LENGTHS[kind] - 11))
    for name, how, offset, width in FIELDS[kind]:
        value = values.get(name)
        if how == "u":
            out[offset : offset + width] = (value or 0).to_bytes(width, "big")
        else:
            out[offset : offset + width] = (("Y" if value else "N") if how == "y" else value or "").encode().ljust(width)
    return bytes(out)


def framed(body: bytes) -> bytes:
    return struct.pack(">H", len(body)) + body


class Plain:
    """A book by sums over resting orders, slow and simple; it shares nothing with the book that is tested against it."""

    def __init__(self) -> None:
        self.resting: dict[int, list] = {}

    def best(self) -> tuple[int, int, int, int]:
        out = []
        for side, pick in (("B", max), ("S", min)):
            price = pick((p for s, p, _ in self.resting.values() if s == side), default=0)
            out += [price, sum(q for s, p, q in self.resting.values() if s == side and p == price)]
        return tuple(out)


def feed(messages: int, symbols: int = 3, seed: int = 1, symbol: str = "SYN", price: int = 1_000_000) -> Iterator[tuple[bytes, tuple | None]]:
    """(message, truth row or None): the truth is seq, ts, type, bid, bid_shares, ask, ask_shares of the first symbol's book."""
    rng = random.Random(seed)
    names = [symbol if not i else f"{symbol[:6]}{i}" for i in range(symbols)]
    books, ref, ts, seq, live = [Plain() for _ in names], 0, OPEN, 0, [[] for _ in names]
    yield message("S", ts, 0, event_code="O"), None
    for i, name in enumerate(names):
        yield message("R", ts, i + 1, stock=name, round_lot=100), None
        yield message("H", ts, i + 1, stock=name, trading_state="T"), None
    yield message("S", ts, 0, event_code="Q"), None
    for _ in range(messages):
        i, ts = rng.randrange(symbols), ts + rng.randint(1, STEP)
        kind = rng.choices(list(MIX), list(MIX.values()))[0]
        book, mine = books[i], live[i]
        if kind in "DUXEC" and not mine:
            kind = "A"
        side, at, shares = rng.choice("BS"), 0, rng.randint(1, 20) * 100
        at = price + (rng.randint(-30, -1) if side == "B" else rng.randint(1, 30)) * TICK
        values = {}
        if kind in "AF":
            ref += 1
            book.resting[ref] = [side, at, shares]
            mine.append(ref)
            values = {"order_ref": ref, "side": side, "shares": shares, "stock": names[i], "price": at, "attribution": "MPID"}
        elif kind == "P":
            values = {"side": side, "shares": shares, "stock": names[i], "price": at, "match_number": seq}
        else:
            k = rng.randrange(len(mine))
            old = mine[k]
            own, level, rest = book.resting[old]
            cut = rest if kind in "DU" or rng.random() < 0.4 else rng.randint(1, rest)
            values = {"order_ref": old, "shares": cut, "match_number": seq, "printable": rng.random() < 0.8, "exec_price": level + rng.choice((-TICK, 0, TICK))}
            book.resting[old][2] -= cut
            if cut == rest:
                del book.resting[old]
                mine[k] = mine[-1]
                mine.pop()
            if kind == "U":
                ref += 1
                again = price + (rng.randint(-30, -1) if own == "B" else rng.randint(1, 30)) * TICK
                book.resting[ref] = [own, again, shares]
                mine.append(ref)
                values = {"order_ref": old, "new_order_ref": ref, "shares": shares, "price": again}
        truth = (seq, ts, kind, *book.best()) if not i else None
        seq += not i
        yield message(kind, ts, i + 1, **values), truth
    yield message("S", ts + 1, 0, event_code="M"), None
    yield message("S", ts + 2, 0, event_code="C"), None


def write(path: str, truth_path: str | None, messages: int, **how) -> int:
    """Write a feed, and its truth as CSV; the number of messages."""
    n = 0
    with open(path, "wb") as out, open(truth_path or "/dev/null", "w") as told:
        told.write("seq,ts,type,bid,bid_shares,ask,ask_shares\n")
        for body, row in feed(messages, **how):
            out.write(framed(body))
            n += 1
            if row:
                told.write(",".join(map(str, row)) + "\n")
    return n
