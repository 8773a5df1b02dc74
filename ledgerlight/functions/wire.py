"""Numbers and text in wire bytes, as Catalyst expressions in both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(body: Column, offset: int, width: int) -> Column:
    """``width`` bytes at a zero-based offset."""
    return F.substring(body, offset + 1, width)


def big(body: Column, offset: int, width: int) -> Column:
    """An unsigned big-endian number; eight bytes keep their bit pattern in a signed long."""
    return F.conv(F.hex(take(body, offset, width)), 16, -10 if width == 8 else 10).cast("bigint")


def little(body: Column, offset: int, width: int) -> Column:
    """A little-endian number: unsigned below eight bytes, signed at eight."""
    swapped = F.concat(*[take(body, offset + i, 1) for i in reversed(range(width))])
    return F.conv(F.hex(swapped), 16, -10 if width == 8 else 10).cast("bigint")


def letters(body: Column, offset: int, width: int) -> Column:
    """ASCII text, padded on the right; spaces inside stay."""
    return F.rtrim(F.decode(take(body, offset, width), "US-ASCII"))


def put_big(value: Column, width: int) -> Column:
    return F.unhex(F.right(F.lpad(F.hex(value.cast("bigint")), 16, "0"), F.lit(2 * width)))


def put_little(value: Column, width: int) -> Column:
    straight = put_big(value, width)
    return F.concat(*[F.substring(straight, i + 1, 1) for i in reversed(range(width))])


def put_letters(value: Column, width: int) -> Column:
    return F.encode(F.rpad(value, width, " "), "US-ASCII")


def price_text(price: Column) -> Column:
    """A price in ten-thousandths of a dollar as dollars with four decimals."""
    return F.format_string("%d.%04d", F.call_function("div", price, F.lit(10000)), price % 10000)


def money(cents: Column) -> Column:
    """Cents as dollars with one decimal and k, M or B; below a thousand as whole dollars."""
    dollars = cents / 100.0
    size = F.abs(dollars)
    text = F.when(size >= 1e9, F.format_string("$%.1fB", dollars / 1e9)).when(size >= 1e6, F.format_string("$%.1fM", dollars / 1e6))
    return text.when(size >= 1e3, F.format_string("$%.1fk", dollars / 1e3)).otherwise(F.format_string("$%.0f", dollars))
