"""Feeds made for tests, and a plain book to hold the fold against."""

import random

from ledgerlight.sources import synthetic
from ledgerlight.sources.synthetic import message  # noqa: F401


def framed(messages):
    return b"".join(synthetic.framed(m) for m in messages)


def random_orders(n, seed, replaces=True):
    """(seq, ts, type, ref, new ref, side, shares, price, execution price, printable) rows, odd ones among them."""
    rng, live, ref, rows = random.Random(seed), [], 1, []
    for seq in range(n):
        kind = rng.choices("AFDUXECP", [38, 3, 33, 12 if replaces else 0, 6, 5, 1, 2])[0]
        if kind in "DUXEC" and (not live or rng.random() < 0.03):
            target = 10**9 + seq if not live else live[-1]
            if not live:
                kind = rng.choice("AXE")
        else:
            target = rng.choice(live) if live else 0
        price = 1_000_000 + rng.randint(-8, 8) * 100 + (50 if rng.random() < 0.02 else 0)
        shares = rng.choice([0, 100, 200, 300]) if rng.random() < 0.05 else rng.randint(1, 5) * 100
        row = [seq, seq * 1000, kind, None, None, None, shares, price, None, None]
        if kind in "AF":
            row[3], row[5] = (ref if rng.random() > 0.02 or not live else rng.choice(live)), rng.choice("BS")
            live.append(row[3])
            ref += 1
        elif kind == "P":
            row[3], row[5] = 0, "B"
        else:
            row[3] = target
            if kind == "U":
                row[4] = ref
                ref += 1
                live.append(row[4])
            if kind == "C":
                row[8], row[9] = price + 100, rng.random() < 0.7
            if kind in "DU" and target in live:
                live.remove(target)
        rows.append(tuple(row))
    return rows


def plain_tops(rows, tick=100):
    """The top of the book after each row, by sums over all that rests; no shared code with the fold."""
    orders, levels, out = {}, {"B": {}, "S": {}}, []

    def add(side, price, shares):
        if price % tick == 0:
            q, c = levels[side].get(price, (0, 0))
            levels[side][price] = (q + shares, c + 1)

    def take(side, price, shares, gone):
        if price in levels[side]:
            q, c = levels[side][price]
            q, c = q - shares, c - (1 if gone and c else 0)
            if q <= 0:
                del levels[side][price]
            else:
                levels[side][price] = (q, c)

    for seq, _, kind, ref, new, side, shares, price, _, _ in rows:
        if kind in "AF" and shares:
            orders[ref] = [side, price, shares]
            add(side, price, shares)
        elif kind in "ECXDU" and ref in orders:
            s, p, rest = orders[ref]
            cut = rest if kind in "DU" else min(shares, rest)
            orders[ref][2] -= cut
            if cut == rest:
                del orders[ref]
            take(s, p, cut, cut == rest)
            if kind == "U" and shares:
                orders[new] = [s, price, shares]
                add(s, price, shares)
        bid, ask = max(levels["B"], default=None), min(levels["S"], default=None)
        out.append((seq, bid, *(levels["B"][bid] if bid else (None, None)), ask, *(levels["S"][ask] if ask else (None, None))))
    return out
