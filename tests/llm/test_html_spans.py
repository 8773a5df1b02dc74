"""Tables whose cells span rows and columns, against a grid of marked places."""

import random
import time

import pytest

from ledgerlight.llm.html import Layout, page_text


def marked(rows):
    """The column of each cell, by marking every place that a cell takes. rows: lists of (colspan, rowspan)."""
    taken, out = set(), []
    for y, row in enumerate(rows):
        x, line = 0, []
        for wide, high in row:
            while (y, x) in taken:
                x += 1
            line.append(x)
            taken |= {(y + d, x + r) for d in range(1, min(high, len(rows) - y)) for r in range(wide)}
            x += wide
        out.append(line)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_cells_stand_where_the_marks_leave_room(seed, monkeypatch):
    rng = random.Random(seed)
    rows = [[(rng.choice((1, 1, 1, 2, 4)), rng.choice((1, 1, 2, 3, 9))) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 12))]
    columns = marked(rows)
    page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{'q' * 3}{y}.{i}</td>" for i, (w, h) in enumerate(row)) + "</tr>" for y, row in enumerate(rows)) + "</table>"
    widths = {}
    for y, row in enumerate(rows):
        for i, (wide, _) in enumerate(row):
            if wide == 1:
                widths[columns[y][i]] = max(widths.get(columns[y][i], 0), len(f"qqq{y}.{i}"))
    out = Layout()
    for y, row in enumerate(rows):
        line = ""
        for i in range(len(row)):
            start = sum(w + 2 for x, w in widths.items() if x < columns[y][i])
            line = (line.ljust(start) if len(line) < start or not line else line + "  ") + f"qqq{y}.{i}"
        if row:
            out.add([line])
    assert page_text(page)[1] == "\n".join(out.done())


@pytest.mark.parametrize("cell", ["<tr><td colspan=1000 rowspan=1000>x", "<tr><td rowspan=1000>x<td colspan=1000>y<td rowspan=500>z"])
def test_a_thousand_spanned_rows_are_quick(cell):
    start = time.time()
    text = page_text("<table>" + cell * 1000)[1]
    assert time.time() - start < 1.5 and text.count("x") == 1000
