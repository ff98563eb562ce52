"""Answers of word problems, checked by reading a question's quantities and what it is about.

A question is read once: its ratios, its quantities with their units (the last unit of a list like "6 and 3 days" holds for the whole
list), and its topics, found as words. A rule says which topics it needs and computes the answer from quantities of the right
units. Rules whose topics another fitting rule needs among more are out; if the rest give different answers, nobody decides.
A verdict is 1, 0 or null (no rule, or a conflict).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cached_property

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import ASCII_DIGITS, BENGALI_DIGITS

_DIGITS = str.maketrans(BENGALI_DIGITS, ASCII_DIGITS)
_NUMBER = r"\d+(?:,\d{2,3})*(?:\.\d+)?(?:/\d+)?"
_LETTER = "A-Za-zঀ-৿"

# Weekdays in order, small numerals, units and topics by their wording. A Bengali word may go on with an ending, an
# English one not; "a b" are words in a row.
WEEKDAYS = ["রবিবার", "সোমবার", "মঙ্গলবার", "বুধবার", "বৃহস্পতিবার", "শুক্রবার", "শনিবার"]
COUNTS = {"একটি": 1, "দুটি": 2, "দুইটি": 2, "তিনটি": 3, "চারটি": 4, "পাঁচটি": 5, "ছয়টি": 6, "সাতটি": 7, "আটটি": 8, "নয়টি": 9, "দশটি": 10, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
TIMES = {"দ্বিগুণ": 2, "দুইগুণ": 2, "তিনগুণ": 3, "চারগুণ": 4, "পাঁচগুণ": 5, "twice": 2, "double": 2, "three times": 3, "triple": 3, "four times": 4}
UNITS = {
    "percent": "%|শতাংশ|ভাগ হারে|percent|per cent",
    "year": "বছ|বৎস|years?",
    "day": "দিন|days?",
    "hour": "ঘণ্টা|ঘন্টা|hours?",
    "minute": "মিনিট|minutes?",
    "person": "জন|persons?|people|men|workers",
    "speed": "কিমি/ঘ|কি.মি./ঘ|কিলোমিটার বেগ|কিমি বেগ|km/h|kmph|km per hour",
    "length": "কিমি|কি.মি.|কিলোমিটার|মিটার|সেমি|km|kilometres?|metres?|cm",
    "money": "টাকা|taka|dollars?",
}
TOPICS = {
    "together": "দুজনে|দু'জনে|উভয়ে|তিনজনে|একত্রে|together",
    "work": "কাজ|প্রকল্প|work|job",
    "share": "ব্যবসায়িক অংশীদার|মিশ্রণে|অনুপাত|business partners|mixture|ratio",
    "sum": "সমষ্টি|মোট|যোগফল|total|sum",
    "partners": "ব্যবসায়িক অংশীদার|business partners",
    "mixture": "মিশ্রণে|mixture",
    "first price": "শুরুর দাম|প্রাথমিক মূল্য|initial price",
    "cost": "ক্রয়মূল্য|কেনা|কিনে|cost price|bought",
    "sale": "বিক্র|sold|selling price|sale price",
    "loss": "ক্ষতি|loss",
    "profit": "লাভ|profit",
    "rate asked": "শতকরা হার|শতকরা কত|what percent|how many percent",
    "simple interest": "সরল সুদ|simple interest",
    "interest": "সুদ|interest",
    "interest rate": "সুদের হার|rate of interest|interest rate",
    "principal": "আসল|principal",
    "same way": "একই দিকে|same direction",
    "each other": "একে অপরের দিকে|পরস্পরের দিকে|towards each other",
    "meet": "মিলিত|meet",
    "distance": "দূরত্ব|distance|how far apart",
    "cycles": "সংকেত বাতি|বাস স্টপেজ|signal lights|traffic lights",
    "group": "প্যানেল|উপকমিটি|panel|subcommittee",
    "among": "মধ্য থেকে|মধ্যে থেকে|from among",
    "weekday": "সপ্তাহের কোন|which weekday|what weekday",
    "later": "দিন পরে|দিন পরবর্তী|days later",
    "average": "গড়|average",
    "newcomer": "গড়মান|গড় নম্বর|নতুন|যোগ দেওয়|joins|new member",
    "root": "বর্গমূল|square root|√",
    "equal": "সমান|equal",
    "fraction": "ভগ্নাংশ|fraction",
    "binary": "বাইনারি|বাইনারী|binary",
    "hexadecimal": "হেক্সাডেসিম্যাল|হেক্সাডেসিমেল|hexadecimal",
    "plus": "যোগ|sum|add",
    "log": "log",
    "prime": "মৌলিক|prime",
    "multiple": "গুণিতক|multiple",
    "chance": "সম্ভাবনা|probability",
    "two digits": "দুই অঙ্কবিশিষ্ট|দুই অঙ্কের|two-digit",
    "units digit": "এককের অঙ্ক|একক স্থানীয় অঙ্ক|units digit",
    "value of x": "x এর মান|x-এর মান|value of x|solve for x",
    "value of k": "k এর মান|k-এর মান|value of k",
    "pendulum": "দোলনকাল|দোলক|pendulum",
    "gravity": "মাধ্যাকর্ষণজনিত ত্বরণ|অভিকর্ষজ ত্বরণ|gravity",
    "less": "কম|কমে|less|smaller|lower",
    "equilateral": "সমবাহু ত্রিভুজ|equilateral triangle",
    "height": "উচ্চতা|height",
    "whole numbers": "পূর্ণসংখ্যা|whole numbers|integers",
    "not": "পারে না|cannot|can not",
    "square inch": "বর্গইঞ্চি|বর্গ ইঞ্চি|square inch|square inches",
    "square centimetre": "বর্গ সেন্টিমিটার|বর্গসেন্টিমিটার|square centimetre|square centimetres|square cm",
    "series": "ধারাটির কোন পদ|ধারার কততম পদ|which term",
    "wife": "স্ত্রী|wife",
    "son": "ছেলে|পুত্র|son",
    "age": "বয়স|age|ages",
    "extra": "অতিরিক্ত|extra|more men|more workers",
    "same speed": "একই দ্রুততায়|একই গতিতে|same speed",
    "train": "একটি ট্রেন|ট্রেন|train",
    "grown": "সুদে-আসলে|সুদে আসলে|amounts to|becomes",
    "set": "সেট A|set A",
    "which": "নিচের কোন|কোনটি|which of",
    "golden": "গোল্ডেন রেশিও|সোনালি অনুপাত|golden ratio",
    "per money": "টাকায়|per taka",
}


def plain(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(_DIGITS)


def _words(alternatives: str) -> re.Pattern:
    """A pattern of whole words: a Bengali one may have an ending."""
    out = []
    for w in unicodedata.normalize("NFKC", alternatives).split("|"):
        bengali, letters = re.search("[ঀ-৿]", w), re.match(r"[\wঀ-৿]", w)
        body = w if "?" in w else re.escape(w)
        end = rf"(?![{_LETTER}])" if letters and not bengali else ""
        out.append((rf"(?<![{_LETTER}])" if letters else "") + body + end)
    return re.compile("|".join(out), re.I)


_TOPICS = {k: _words(v) for k, v in TOPICS.items()}
_UNITS = {k: re.compile(r"\s*(?:" + _words(v).pattern.replace(rf"(?<![{_LETTER}])", "") + ")", re.I) for k, v in UNITS.items()}


def value_of(token: str) -> Fraction:
    top, _, bottom = token.replace(",", "").partition("/")
    return Fraction(top) / int(bottom) if bottom else Fraction(top)


@dataclass
class Quantity:
    value: Fraction
    unit: str | None
    start: int
    end: int


@dataclass
class Reading:
    """What a question says."""

    text: str
    ratio: list[int] = field(default_factory=list)
    quantities: list[Quantity] = field(default_factory=list)

    @cached_property
    def topics(self) -> frozenset[str]:
        return frozenset(k for k, p in _TOPICS.items() if p.search(self.text))

    def of(self, *units: str | None) -> list[Fraction]:
        return [q.value for q in self.quantities if q.unit in units]

    def bare(self) -> list[Fraction]:
        """Amounts: neither percents nor times."""
        return [q.value for q in self.quantities if q.unit not in ("percent", "year", "day", "hour", "minute")]

    def after(self, topic: str) -> Fraction:
        at = _TOPICS[topic].search(self.text).end()
        return next(q.value for q in self.quantities if q.start >= at)

    def find(self, pattern: str) -> re.Match:
        return re.search(pattern, self.text, re.I)


def read(question: str | None) -> Reading:
    text = plain(question)
    ratio, taken = [], []
    for m in re.finditer(r"(?<![\d.])\d+(?:\s*:\s*\d+)+", text):
        ratio = ratio or [int(x) for x in m[0].split(":")]
        taken.append(m.span())
    found = []
    for m in re.finditer(_NUMBER, text):
        if any(a <= m.start() < b for a, b in taken) or "/" in m[0] and not int(m[0].split("/")[1]):
            continue
        unit = next((k for k, p in _UNITS.items() if p.match(text, m.end())), None)
        found.append(Quantity(value_of(m[0]), unit, m.start(), m.end()))
    for left, right in zip(found[-2::-1], found[:0:-1], strict=True):  # the unit of a list stands at its end
        if left.unit is None and re.fullmatch(r"\s*(?:,|ও|এবং|and|, ও|, and)\s*", text[left.end : right.start]):
            left.unit = right.unit
    return Reading(text, ratio, found)


class Unclear(ValueError):
    """The question lacks what a rule needs."""


def _need(ok: bool) -> None:
    if not ok:
        raise Unclear


def _exactly(values: list[Fraction], n: int) -> list[Fraction]:
    _need(len(values) == n)
    return values


def _whole(*values: Fraction) -> list[int]:
    _need(all(v.denominator == 1 and v >= 0 for v in values))
    return [int(v) for v in values]


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, math.isqrt(n) + 1))


Answer = Fraction | str | Callable[[str], bool]
RULES: dict[str, tuple[frozenset[str], Callable[[Reading], Answer]]] = {}


def rule(*topics: str):
    def add(f: Callable[[Reading], Answer]):
        RULES[f.__name__] = (frozenset(topics), f)
        return f

    return add


@rule("together", "work")
def joint_work(r):
    days = r.of("day", "hour")
    _need(len(days) in (2, 3) and all(days))
    return 1 / sum(1 / d for d in days)


@rule("share", "sum")
def part_of_total(r):
    (total,) = _exactly([q.value for q in r.quantities], 1)
    _need(len(r.ratio) in (2, 3))
    return total * r.ratio[1] / sum(r.ratio)


@rule("share", "partners")
def part_of_partners(r):
    _need(len(r.ratio) == 3)
    return part_of_total(r)


@rule("share", "mixture")
def part_of_mixture(r):
    _need(len(r.ratio) == 2)
    return part_of_total(r)


@rule("first price")
def raised_then_cut(r):
    up, down = _exactly(r.of("percent"), 2)
    return r.after("first price") * (1 + up / 100) * (1 - down / 100)


@rule("cost", "sale")
def sale_price(r):
    (share,), (cost,) = _exactly(r.of("percent"), 1), _exactly(r.bare(), 1)
    _need("rate asked" not in r.topics)
    return cost * (1 - share / 100 if "loss" in r.topics else 1 + share / 100)


@rule("sale", "loss", "rate asked")
def loss_rate(r):
    cost, got = _exactly(r.bare(), 2)
    _need(cost > got)
    return (cost - got) / cost * 100


@rule("cost", "sale", "per money")
def unit_profit(r):
    bought, sold = [n for _, n in sorted((m.start(), n) for w, n in COUNTS.items() for m in re.finditer(rf"(?<![{_LETTER}]){unicodedata.normalize('NFKC', w)}", r.text))]
    return abs(Fraction(bought, sold) - 1) * 100


@rule("simple interest")
def interest_earned(r):
    (rate,), (years,), (sum_,) = _exactly(r.of("percent"), 1), _exactly(r.of("year"), 1), _exactly(r.bare(), 1)
    return sum_ * rate * years / 100


@rule("interest rate", "principal", "interest")
def interest_rate_of_part(r):
    (years,) = _exactly(r.of("year"), 1)
    (part,) = _exactly([x for x in r.bare() if 0 < x < 1], 1)
    return part / years * 100


@rule("interest rate", "grown")
def interest_rate_to_multiple(r):
    (years,) = _exactly(r.of("year"), 1)
    times = next((n for w, n in TIMES.items() if _words(w).search(r.text)), None)
    _need(times is not None)
    return Fraction(times - 1) * 100 / years


@rule("same way", "distance")
def gap_after(r):
    a, b = _exactly(r.of("speed", "length", None), 2)
    (time,) = _exactly(r.of("hour", "minute"), 1)
    return abs(a - b) * time


@rule("each other", "meet")
def time_to_meet(r):
    apart, a, b = _exactly(r.of("length", "speed", None), 3)
    return apart / (a + b)


@rule("cycles")
def common_cycle(r):
    _need(len(r.quantities) >= 2)
    return Fraction(math.lcm(*_whole(*(q.value for q in r.quantities))))


@rule("group", "among")
def ways_to_choose(r):
    n, k = sorted(_whole(*_exactly([q.value for q in r.quantities], 2)))[::-1]
    return Fraction(math.comb(n, k))


@rule("weekday", "later")
def day_after(r):
    start = next((i for i, d in enumerate(WEEKDAYS) if unicodedata.normalize("NFKC", d) in r.text), None)
    _need(start is not None)
    (days,) = _whole(*_exactly(r.of("day"), 1))
    return WEEKDAYS[(start + days) % 7]


@rule("average", "newcomer")
def newcomer_of_average(r):
    n, old, new = _exactly([q.value for q in r.quantities], 3)
    return (n + 1) * new - n * old


@rule("average", "wife", "son", "age")
def son_of_averages(r):
    two, three = _exactly(r.of("year", None), 2)
    return 3 * three - 2 * two


@rule("root")
def square_root(r):
    (n,) = _exactly([q.value for q in r.quantities], 1)
    top, bottom = math.isqrt(n.numerator), math.isqrt(n.denominator)
    _need(top * top == n.numerator and bottom * bottom == n.denominator)
    return Fraction(top, bottom)


@rule("equal", "fraction")
def fraction_of_percent(r):
    m = r.find(rf"(\d+)\s+(\d+/\d+)\s*%|({_NUMBER})\s*%")
    _need(m is not None)
    return (int(m[1]) + value_of(m[2]) if m[1] else value_of(m[3])) / 100


@rule()
def percent_of_amount(r):
    m = r.find(rf"({_NUMBER})\s*%\s*of\s*({_NUMBER})|({_NUMBER})\s*(?:টাকা)?র\s*({_NUMBER})\s*%\s*(?:কত|=)")
    _need(m is not None)
    a, b = (m[1], m[2]) if m[1] else (m[4], m[3])
    return value_of(a) * value_of(b) / 100


@rule()
def power_sum(r):
    plus, times, asked = r.find(r"([a-z])\s*\+\s*([a-z])\s*=\s*(-?\d+)"), r.find(r"\b([a-z])\s*\*?\s*([a-z])\s*=\s*(-?\d+)"), r.find(r"[a-z]\s*(?:\^|\*\*)?\s*([23])\s*\+\s*[a-z]\s*(?:\^|\*\*)?\s*\1(?!\d)")
    _need(None not in (plus, times, asked) and {plus[1], plus[2]} == {times[1], times[2]})
    s, p = Fraction(plus[3]), Fraction(times[3])
    return s**2 - 2 * p if asked[1] == "2" else s**3 - 3 * p * s


@rule("log")
def logarithm(r):
    terms = re.findall(r"([+-]?)\s*log_?\{?(\d+)\}?\s*\(?\s*(\d+)\s*\)?", r.text, re.I)
    _need(bool(terms) and len({b for _, b, _ in terms}) == 1)
    base, product = int(terms[0][1]), Fraction(1)
    for sign, _, x in terms:
        product = product / int(x) if sign == "-" else product * int(x)
    _need(base > 1 and product > 0)
    power = round(math.log(product) / math.log(base))
    _need(Fraction(base) ** power == product)
    return Fraction(power)


def _polynomial(side: str, unknown: str) -> dict[tuple[int, int], Fraction]:
    """Coefficients by (power of x, power of the unknown) of a sum of plain terms."""
    out: dict[tuple[int, int], Fraction] = {}
    side = side.replace(" ", "").replace("**", "^").replace("³", "^3").replace("²", "^2")
    _need(bool(side) and re.fullmatch(rf"(?:[+-]?(?:\d+(?:\.\d+)?(?:/\d+)?)?{unknown}?(?:x(?:\^\d)?)?)+", side) is not None)
    for sign, number, k, x, power in re.findall(rf"([+-]?)(\d+(?:\.\d+)?(?:/\d+)?)?({unknown})?(x(?:\^(\d))?)?", side):
        if number or k or x:
            key = (int(power or 1) if x else 0, int(bool(k)))
            out[key] = out.get(key, Fraction(0)) + (value_of(number) if number else 1) * (-1 if sign == "-" else 1)
    return out


@rule("value of x")
def linear_unknown(r):
    m = r.find(r"([-+0-9x./ ]*x[-+0-9x./ ]*)=([-+0-9x./ ]+)") or r.find(r"([-+0-9x./ ]+)=([-+0-9x./ ]*x[-+0-9x./ ]*)")
    _need(m is not None)
    left, right = (_polynomial(side.strip(" ."), "k") for side in m.groups())
    slope, rest = (left.get((p, 0), Fraction(0)) - right.get((p, 0), Fraction(0)) for p in (1, 0))
    _need(slope != 0)
    return -rest / slope


@rule("value of k")
def cubic_unknown(r):
    m, zero = r.find(r"x\s*(?:\^\s*3|³)[-+0-9xk^²³ ]*"), r.find(r"\(?x\s*([+-])\s*(\d+)\s*\)?\s*(?:একটি উৎপাদক|is a factor|দ্বারা বিভাজ্য)|x\s*=\s*(-?\d+)")
    _need(None not in (m, zero))
    x = Fraction(zero[3]) if zero[3] else Fraction(int(zero[2])) * (-1 if zero[1] == "+" else 1)
    terms = _polynomial(m[0].strip(), "k")
    known, by_k = (sum(c * x**p for (p, k), c in terms.items() if k == has) for has in (0, 1))
    _need(by_k != 0)
    return -known / by_k


@rule("fraction")
def recurring_decimal(r):
    m = r.find(r"(\d+)\.(\d*)(?:\((\d+)\)|(\d)\s*[˙̇])")
    _need(m is not None)
    head, cycle = m[2], m[3] or m[4]
    return int(m[1]) + (Fraction(int(head or 0)) + Fraction(int(cycle), 10 ** len(cycle) - 1)) / 10 ** len(head)


@rule("binary", "plus")
def binary_sum(r):
    terms = re.findall(r"\b[01]+\b", r.text)
    _need(len(terms) == 2)
    return f"{int(terms[0], 2) + int(terms[1], 2):b}"


@rule("hexadecimal", "binary")
def hexadecimal_digits(r):
    m = r.find(r"\(?([0-9A-F]+)\)?\s*(?:_\{?16\}?|₁₆|16\b)") or r.find(r"\b([0-9A-F]*\d[0-9A-F]*)\b")
    _need(m is not None)
    return f"{int(m[1], 16):b}"


@rule("prime", "multiple", "chance")
def prime_or_multiple(r):
    low, high, step = _whole(*_exactly([q.value for q in r.quantities], 3))
    _need(step > 0 and low <= high <= 10**6)
    return Fraction(sum(_prime(n) or n % step == 0 for n in range(low, high + 1)), high - low + 1)


@rule("two digits", "units digit")
def two_digit_number(r):
    times = next((n for w, n in TIMES.items() if _words(w).search(r.text)), None)
    total = r.find(r"(?:সমষ্টি|যোগফল|sum)\D{0,12}(\d+)")
    fits = [n for n in range(10, 100) if (times is None or n % 10 == times * (n // 10)) and (total is None or n // 10 + n % 10 == int(total[1]))]
    _need((times is not None or total is not None) and len(fits) == 1)
    return Fraction(fits[0])


@rule("pendulum", "gravity")
def pendulum_period(r):
    slower = _words("বেশি|বাড়|বৃদ্ধি|longer|increases|greater|more")
    faster = _words("কম|হ্রাস|shorter|decreases|less")
    want, other = (slower, faster) if "less" in r.topics else (faster, slower)
    return lambda a: bool(want.search(a)) and not other.search(a)


@rule("equilateral", "height")
def equilateral_height(r):
    (side,) = _exactly(r.of("length", None), 1)
    half = side / 2
    return f"{'' if half == 1 else half}√3"


@rule("whole numbers", "sum", "share")
def ratio_of_whole_numbers(r):
    (total,) = _whole(*_exactly([q.value for q in r.quantities], 1))
    _need(not r.ratio)

    def possible(a: str) -> bool:
        m = re.search(r"(\d+)\s*:\s*(\d+)", a)
        return m is not None and (total % (int(m[1]) + int(m[2])) == 0) != ("not" in r.topics)

    return possible


@rule("square inch", "square centimetre")
def square_inches(r):
    n = r.of(None)
    return (n[0] if n else Fraction(1)) * Fraction("6.4516")


@rule("series")
def term_of_series(r):
    *first, goal = [q.value for q in r.quantities]
    _need(len(first) >= 3 and first[0] != 0)
    step = first[1] / first[0]
    _need(abs(step) > 1 and all(b == a * step for a, b in zip(first, first[1:], strict=False)))
    place, term = 1, first[0]
    while abs(term) < abs(goal):
        place, term = place + 1, term * step
    _need(term == goal)
    return Fraction(place)


@rule("extra", "work")
def extra_hands(r):
    (hands,), (days, fewer) = _exactly(r.of("person"), 1), _exactly(r.of("day"), 2)
    _need(fewer > 0)
    return hands * days / fewer - hands


@rule("train", "same speed")
def same_speed(r):
    (far,), (time, other) = _exactly(r.of("length"), 1), _exactly(r.of("hour", "minute"), 2)
    _need(time > 0)
    return far * other / time


@rule("set")
def set_of_bounds(r):
    m = r.find(r"(\d+)\s*(<|≤|<=)\s*x\s*(<|≤|<=)\s*(\d+)")
    _need(m is not None)
    values = range(int(m[1]) + (m[2] == "<"), int(m[4]) + (m[3] != "<"))
    kept = [n for n in values if "prime" not in r.topics or _prime(n)]
    return lambda a: [int(x) for x in re.findall(r"\d+", a)] == kept


@rule("prime", "which")
def chosen_prime(r):
    def prime(a: str) -> bool:
        found = [value_of(x) for x in re.findall(_NUMBER, a)]
        return len(found) == 1 and found[0].denominator == 1 and _prime(int(found[0]))

    return prime


@rule("golden")
def golden_ratio(r):
    return lambda a: bool(re.search(r"(?<!\d)1\.618?\d*|φ|(?:1\s*\+\s*√\s*5\)?\s*/\s*2)", a))


def right(expected: Answer, response: str | None) -> bool:
    """Whether a response gives the answer: the only predicate, the words, or as its first number the value."""
    text = plain(response)
    if callable(expected):
        return expected(text)
    if isinstance(expected, str):
        return bool(re.search(rf"(?<![\d.]){re.escape(unicodedata.normalize('NFKC', expected))}(?!\d)", text.replace(" ", "") if "√" in expected else text))
    found = re.search(r"-?\s*" + _NUMBER, text)
    return found is not None and value_of(found[0].replace(" ", "")) == expected


def solutions(question: str | None) -> list[tuple[str, Answer]]:
    """(rule, answer) of every rule that fits, without those whose topics are part of another's."""
    r = read(question)
    out = []
    for name, (topics, f) in RULES.items():
        if topics <= r.topics:
            try:
                out.append((name, f(r)))
            except (ValueError, ZeroDivisionError, StopIteration, IndexError, OverflowError):
                continue
    return [(n, a) for n, a in out if not any(RULES[n][0] < RULES[m][0] for m, _ in out)]


def judged(question: str | None, response: str | None) -> tuple[str, str | None, int] | None:
    """(rules, expected, verdict), or None if no rule fits or the fitting ones disagree."""
    found = solutions(question)
    verdicts = {right(a, response) for _, a in found}
    values = {str(a) for _, a in found if not callable(a)}
    if not found or len(verdicts) > 1 or len(values) > 1:
        return None
    return "+".join(n for n, _ in found), next(iter(values), None), int(verdicts.pop())


@F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("expected", T.StringType()), T.StructField("verdict", T.IntegerType())]))
def arithmetic(prompt: pd.Series, response: pd.Series) -> pd.DataFrame:
    """struct(rule, expected, verdict) of a word problem and an answer; nulls if no rule fits or rules disagree."""
    rows = [judged(q, a) or (None, None, None) for q, a in zip(prompt, response, strict=True)]
    return pd.DataFrame(rows, columns=["rule", "expected", "verdict"], dtype=object).astype({"verdict": "Int32"})


def restored(visible: str, response: str | None, formula: Callable[[Fraction], Fraction], lost: str = "front", digits: int = 5) -> Fraction | None:
    """The one number that shows only its last (lost="front") or first (lost="back") digits and makes the response right; None if none or several do."""
    fits = []
    for missing in range(1, digits - len(visible) + 1):
        for n in range(10 ** (missing - 1) if lost == "front" else 0, 10**missing):
            value = Fraction(f"{n}{visible}" if lost == "front" else f"{visible}{n:0{missing}}")
            if right(formula(value), response):
                fits.append(value)
    return fits[0] if len(fits) == 1 else None
