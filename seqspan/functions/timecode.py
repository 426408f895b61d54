"""Time codes and time expressions as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def frame_timecode(frame: Column, fps: int) -> Column:
    """``HH:MM:SS.FF`` of a frame number; ``--:--:--.--`` for null."""
    text = once(frame, lambda n: F.format_string("%02d:%02d:%02d.%02d", _div(n, fps * 3600), _div(n, fps * 60) % 60, _div(n, fps) % 60, n % fps))
    return F.when(frame.isNull(), "--:--:--.--").otherwise(text)


def seconds_timecode(seconds: Column, fps: int) -> Column:
    """``HH:MM:SS.FF`` of seconds, 0 at least; the part of a second is rounded (half to even) and may carry over."""
    total = F.greatest(F.lit(0.0), seconds.cast("double"))
    frame = once(total, lambda t: (F.floor(t) * fps + F.bround((t - F.floor(t)) * fps)).cast("long"))
    return F.when(seconds.isNull(), "--:--:--.--").otherwise(frame_timecode(frame, fps))


def parse_timecode(text: Column, fps: int) -> Column:
    """Frame number of ``HH:MM:SS.FF`` (``:`` or ``.`` between), or of up to eight digits filled with zeros; else null."""
    digits = lambda t: F.when(t.rlike(r"^\d+$"), once(F.when(F.length(t) < 8, F.lpad(t, 8, "0")).otherwise(t), lambda p: F.array(*[F.substring(p, i, 2) for i in (1, 3, 5, 7)])))
    four = lambda t: once(F.split(t, r"\."), lambda p: F.when(F.size(p) == 1, digits(t)).when(F.size(p) == 4, p))
    weights = (3600 * fps, 60 * fps, fps, 1)
    # what is no number is told before it is cast: a failing cast costs as much as a hundred good ones
    number = lambda x: F.when(x.rlike(r"^[+-]?\d{1,18}$"), x.cast("long"))
    frame = lambda p: sum((number(F.trim(F.get(p, i))) * w for i, w in enumerate(weights)), F.lit(0).cast("long"))
    return once(once(F.translate(F.trim(text), ":", "."), four), frame)


def ticks(seconds: Column, rate: int = 10_000_000) -> Column:
    """Ticks of seconds, rounded half to even, 0 at least."""
    return F.greatest(F.lit(0).cast("long"), F.bround(seconds * rate).cast("long"))


def clock_text(seconds: Column) -> Column:
    """``H:MM:SS`` of whole seconds, ``M:SS`` under an hour."""
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", _div(s, 3600), _div(s, 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", _div(s, 60), s % 60))


def time_expression(text: Column, duration: Column) -> Column:
    """Seconds (decimal) of ``[-]HH:MM:SS(.f)``, ``[-]MM:SS``, a number, ``s``/``start``, or ``e``/``end``/``-0``; negative ones count from the end.

    Null where it is none of these.
    """
    low = F.lower(F.trim(text))
    number = lambda c: F.when(c.rlike(r"\d"), c.try_cast("decimal(20,6)"))
    minus = F.when(low.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    parts = F.split(F.regexp_replace(low, "^-", ""), ":")
    at = lambda i: number(F.get(parts, F.lit(i)))
    value = F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(parts) == 2, at(0) * 60 + at(1)).when(F.size(parts) == 1, at(0))
    signed = (value * minus).cast("decimal(20,6)")
    whole = duration.cast("decimal(20,6)")
    return F.when(low.isin("s", "start"), F.lit(0).cast("decimal(20,6)")).when(low.isin("e", "end", "-0"), whole).when(signed < 0, (whole + signed).cast("decimal(20,6)")).otherwise(signed)


#: Parts of one that a fraction is told in: 52 bits are all that a double from one on has.
_PARTS = 1 << 52


def _fixed(number: Column, places: int) -> Column:
    """Text of a number with up to three places, rounded by its exact value, half to even, as C's ``printf`` does.

    Java rounds the shortest digits that tell a number from its neighbours, and these may lie on the other side of a half.
    """
    scale = 10**places

    def text(x: Column) -> Column:
        whole = F.floor(F.abs(x))
        parts = ((F.abs(x) - whole) * float(_PARTS)).cast("long") * scale
        down, rest = F.shiftright(parts, 52), parts.bitwiseAND(F.lit(_PARTS - 1))
        up = down + ((rest > _PARTS // 2) | ((rest == _PARTS // 2) & (down % 2 == 1))).cast("long")
        sign = F.when(x < 0, "-").otherwise("")
        return once(up, lambda n: F.concat(sign, (whole + _div(n, scale)).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0")))

    return F.when(F.abs(number) < float(1 << 53), once(number, text)).otherwise(F.format_string(f"%.{places}f", number))


def human_size(size: Column) -> Column:
    """``n bytes``, or ``n.n`` KB, MB, GB or TB, the least that keeps the number under 1024."""
    n = size.cast("double")
    text = F.format_string("%.0f bytes", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        text = F.when(n >= 1024.0**power, F.concat(_fixed(n / 1024.0**power, 1), F.lit(f" {unit}"))).otherwise(text)
    return text


def media_size(size: Column) -> Column:
    """``n.nnn GB`` or ``n.nnn MB`` from one on, else ``n.n KB``; ``N/A`` for what isn't a number."""
    n = size.try_cast("double")
    text = F.when(n >= 1024.0**3, F.concat(_fixed(n / 1024.0**3, 3), F.lit(" GB"))).when(n >= 1024.0**2, F.concat(_fixed(n / 1024.0**2, 3), F.lit(" MB"))).otherwise(F.concat(_fixed(n / 1024.0, 1), F.lit(" KB")))
    return F.when(n.isNull(), "N/A").otherwise(text)
