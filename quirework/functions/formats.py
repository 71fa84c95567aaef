"""Numbers as workbooks display them: a format code is read once, then applied to values.

Codes are those of the spreadsheet file format: up to four sections (positive, negative, zero, text), each of literals,
digit places, thousands and scaling commas, percent, exponents, dates and times.
"""

from __future__ import annotations

import datetime
import functools
import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The codes of built-in format numbers.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|General|AM/PM|A/P|y+|m+|d+|h+|s+(?:\.0+)?|E[+-]|[0#?]+|.', re.IGNORECASE | re.DOTALL)


def general(v: float) -> str:
    """At most eleven characters of digits and point, without zeros at the end; very large or small numbers with an exponent."""
    if v == 0:
        return "0"
    size = math.floor(math.log10(abs(v)))
    if size >= 11 or size < -9:
        head, _, power = f"{v:.5E}".partition("E")
        return f"{head.rstrip('0').rstrip('.')}E{power[0]}{int(power[1:]):02d}"
    text = f"{v:.{max(0, min(9, 9 - size))}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def _literal(token: str) -> str | None:
    """The text of a token that stands for itself; None if it has a meaning."""
    if token[0] == '"':
        return token[1:-1]
    if token[0] == "\\":
        return token[1:]
    if token[0] == "_":
        return " "
    if token[0] == "*":
        return ""
    if token[0] == "[":
        currency = re.fullmatch(r"\[\$([^-\]]*)(?:-[^\]]*)?\]", token)
        return currency[1] if currency else None if re.fullmatch(r"\[(?:h+|m+|s+)\]", token, re.IGNORECASE) else ""
    return None


class Section:
    def __init__(self, code: str):
        self.tokens = _TOKEN.findall(code)
        plain = [t for t in self.tokens if _literal(t) is None]
        self.text = "@" in plain
        self.general = any(t.lower() == "general" for t in plain)
        self.date = not self.general and any(re.fullmatch(r"y+|m+|d+|h+|s+(?:\.0+)?|\[(?:h+|m+|s+)\]|AM/PM|A/P", t, re.IGNORECASE) for t in plain)
        self.condition = re.search(r"\[(<=|>=|<>|<|>|=)\s*(-?[\d.]+)\]", code)

    def meets(self, v: float) -> bool:
        if not self.condition:
            return True
        limit = float(self.condition[2])
        return {"<": v < limit, ">": v > limit, "<=": v <= limit, ">=": v >= limit, "=": v == limit, "<>": v != limit}[self.condition[1]]

    def shown(self, v: float, epoch: int) -> str:
        if self.date:
            return self._date(v, epoch)
        if self.general:
            return "".join(general(v) if t.lower() == "general" else _literal(t) if _literal(t) is not None else t for t in self.tokens)
        return self._number(v)

    def with_text(self, value: str) -> str:
        return "".join(value if t == "@" else _literal(t) if _literal(t) is not None else t for t in self.tokens)

    def _number(self, v: float) -> str:
        digits = [k for k, t in enumerate(self.tokens) if re.fullmatch(r"[0#?]+", t)]
        if not digits:
            return "".join(_literal(t) if _literal(t) is not None else t for t in self.tokens)
        first, last = digits[0], digits[-1]
        point = next((k for k in range(first - 1 if first else 0, last + 1) if self.tokens[k] == "."), None)
        power = next((k for k in range(first, last) if re.fullmatch(r"E[+-]", self.tokens[k], re.IGNORECASE)), None)
        slash = next((k for k in range(first, last) if self.tokens[k] == "/"), None)
        end = power if power is not None else last + 1
        whole = "".join(t for k, t in enumerate(self.tokens[:end]) if k in digits and (point is None or k < point))
        after = "".join(t for k, t in enumerate(self.tokens[:end]) if k in digits and point is not None and k > point)
        if slash is not None:
            return self._fraction(v, digits, slash)
        number = Decimal(repr(v)).scaleb(2 * sum(t == "%" for t in self.tokens))
        commas = [k for k in range(first, end) if self.tokens[k] == ","]
        edge = max((k for k in digits if k < end and (point is None or k < point)), default=first)
        thousands = any(k < edge for k in commas)
        tail = max(k for k in digits if k < end)
        scale = next((n for n, t in enumerate(self.tokens[tail + 1 :]) if t != ","), len(self.tokens) - tail - 1)
        number = number.scaleb(-3 * scale)
        exponent = ""
        if power is not None:
            step = max(1, len(whole))
            size = number.adjusted() if number else 0
            size = size // step * step if step > 1 else size
            number = number.scaleb(-size)
            if abs(number.quantize(Decimal(1).scaleb(-len(after)), ROUND_HALF_UP)) >= 10**step:
                size, number = size + step, number.scaleb(-step)
            places = len(self.tokens[last])
            sign = "-" if size < 0 else "+" if self.tokens[power][1] == "+" else ""
            exponent = f"{self.tokens[power][0]}{sign}{abs(size):0{places}d}"
        number = number.quantize(Decimal(1).scaleb(-len(after)), ROUND_HALF_UP)
        left, _, right = f"{abs(number):f}".partition(".")
        left = left.lstrip("0").rjust(0)
        need = len(whole) - len(whole.lstrip("#")) if whole.strip("#") else len(whole)
        left = left.rjust(len(whole) - need, "0" if "?" not in whole else " ")
        if thousands:
            left = re.sub(r"(?<=\d)(?=(?:\d{3})+\Z)", ",", left)
        keep = max((k + 1 for k, t in enumerate(after) if t in "0?"), default=0)
        right = right[:keep] + right[keep:].rstrip("0")
        if point is None and power is None and any(self.tokens[k] not in ",%" and k not in digits for k in range(first, last)):
            return ("-" if number < 0 else "") + self._spread(left, digits)
        out, put = [], False
        for k, t in enumerate(self.tokens):
            literal = _literal(t)
            if literal is not None:
                out.append(literal)
            elif k in digits or (first <= k <= last and t in ".,") or (t == "." and k == point) or (t == "," and k > tail):
                if not put:
                    out.append(left + ("." + right if point is not None else "") + exponent)
                    put = True
            elif power is not None and k == power:
                continue
            else:
                out.append(t)
        text = "".join(out)
        return f"-{text}" if number < 0 else text

    def _spread(self, left: str, digits: list[int]) -> str:
        """Digits dealt from the right to groups of places with other characters between them."""
        groups: dict[int, str] = {}
        rest = left.replace(",", "")
        for k in reversed(digits):
            n = len(rest) if k == digits[0] else min(len(rest), len(self.tokens[k]))
            groups[k], rest = rest[len(rest) - n :], rest[: len(rest) - n]
        return "".join(groups[k] if k in groups else _literal(t) if _literal(t) is not None else "" if t == "," else t for k, t in enumerate(self.tokens))

    def _fraction(self, v: float, digits: list[int], slash: int) -> str:
        """A whole part (if the code has one) and the nearest fraction whose denominator has as many digits."""
        below = next(k for k in digits if k > slash)
        above = max(k for k in digits if k < slash)
        most = 10 ** len(self.tokens[below]) - 1
        with_whole = any(k < above for k in digits)
        whole, rest = divmod(abs(v), 1) if with_whole else (0, abs(v))
        near = min(range(1, most + 1), key=lambda d: (round(abs(rest - round(rest * d) / d), 12), d))
        top = round(rest * near)
        if with_whole and top == near:
            whole, top = whole + 1, 0
        sign = "-" if v < 0 else ""
        if with_whole and not top:
            return f"{sign}{int(whole)}" + " " * (len(self.tokens[above]) + len(self.tokens[below]) + 2)
        part = f"{top}".rjust(len(self.tokens[above])) + "/" + f"{near}".ljust(len(self.tokens[below]))
        return f"{sign}{int(whole)} {part}" if whole else f"{sign}{part}"

    def _date(self, v: float, epoch: int) -> str:
        if v < 0:
            return "#" * 8
        places = max((len(t.partition(".")[2]) for t in self.tokens if re.fullmatch(r"s+\.0+", t, re.IGNORECASE)), default=0)
        ticks = int(Decimal(repr(v)).__mul__(86400 * 10**places).quantize(Decimal(1), ROUND_HALF_UP))
        seconds, part = divmod(ticks, 10**places)
        days, clock = divmod(seconds, 86400)
        # Serial 60 of the older epoch is a day that never was; earlier serials count from the last day of 1899.
        phantom = epoch == 1900 and days == 60
        start = datetime.date(1904, 1, 1) if epoch == 1904 else datetime.date(1899, 12, 31 if days < 60 else 30)
        try:
            day = datetime.date(1900, 2, 28) if phantom else start + datetime.timedelta(days)
        except OverflowError:
            return "#" * 8
        hour, minute, second = clock // 3600, clock // 60 % 60, clock % 60
        half = any(re.fullmatch(r"AM/PM|A/P", t, re.IGNORECASE) for t in self.tokens)
        out, last = [], ""
        for k, t in enumerate(self.tokens):
            low = t.lower()
            literal = _literal(t)
            if literal is not None:
                out.append(literal)
                continue
            kind = low[0] if re.fullmatch(r"y+|m+|d+|h+|s+(?:\.0+)?", low) else ""
            if kind == "m":
                later = next((x.lower() for x in self.tokens[k + 1 :] if re.fullmatch(r"(?i)y+|m+|d+|h+|s+(?:\.0+)?|\[.*\]", x)), "")
                kind = "minute" if last in ("h", "[h]") or later.startswith(("s", "[s")) else "m"
            if kind == "y":
                out.append(f"{day.year:04d}" if len(low) > 2 else f"{day.year % 100:02d}")
            elif kind == "m":
                out.append(str(day.month) if len(low) == 1 else f"{day.month:02d}" if len(low) == 2 else _MONTHS[day.month - 1][: 3 if len(low) == 3 else 1 if len(low) == 5 else None])
            elif kind == "d":
                number = 29 if phantom else day.day
                # In the older epoch weekdays before its phantom day are off by one.
                name = _DAYS[(day.weekday() - (epoch == 1900 and days < 60)) % 7]
                out.append(str(number) if len(low) == 1 else f"{number:02d}" if len(low) == 2 else name[:3] if len(low) == 3 else name)
            elif kind == "h":
                h = (hour - 1) % 12 + 1 if half else hour
                out.append(f"{h:0{min(2, len(low))}d}")
            elif kind == "minute":
                out.append(f"{minute:0{min(2, len(low))}d}")
            elif kind == "s":
                head = low.partition(".")[0]
                out.append(f"{second:0{min(2, len(head))}d}" + (f".{part:0{places}d}" if "." in low else ""))
            elif low in ("am/pm", "a/p"):
                out.append(("AM" if hour < 12 else "PM") if low == "am/pm" else ("A" if hour < 12 else "P"))
            elif re.fullmatch(r"\[(?:h+|m+|s+)\]", low):
                total = seconds // {"h": 3600, "m": 60, "s": 1}[low[1]]
                out.append(f"{total:0{len(low) - 2}d}")
                kind = f"[{low[1]}]"
            else:
                out.append(t)
            last = kind or last
        return "".join(out)


@functools.cache
def sections(code: str) -> list[Section]:
    parts, at = [""], 0
    for token in _TOKEN.findall(code):
        if token == ";":
            parts.append("")
            at += 1
        else:
            parts[at] += token
    return [Section(p) for p in parts[:4]]


def display(value: str, kind: str, code: str, epoch: int) -> str:
    """A stored value as its cell shows it; what isn't a number, or has no place in its code, stays as it is."""
    found = sections(code)
    if kind != "n":
        return next((s for s in found if s.text), Section("@")).with_text(value) if kind == "s" else value
    try:
        v = float(value)
    except ValueError:
        return value
    if not math.isfinite(v):
        return value
    numbers = [s for s in found if not s.text] or [Section("General")]
    if any(s.condition for s in numbers):
        own = next((s for s in numbers if s.condition and s.meets(v)), next((s for s in numbers if not s.condition), Section("General")))
        return own.shown(v, epoch)
    if v < 0 and len(numbers) > 1:
        return numbers[1].shown(-v, epoch)
    if v == 0 and len(numbers) > 2:
        return numbers[2].shown(v, epoch)
    return numbers[0].shown(v, epoch)


@F.pandas_udf(StringType())
def _display(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for columns in batches:
        yield pd.Series([None if v is None else display(v, k, c, int(e)) for v, k, c, e in zip(*columns, strict=True)], dtype=object)


def displayed(value: Column, kind: Column, code: Column, epoch: Column) -> Column:
    """value (a string as it is stored), kind (n: number, s: text) and its format code, as displayed. Call it on cells whose code isn't General text."""
    return _display(value, kind, code, epoch)
