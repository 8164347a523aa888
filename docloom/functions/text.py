"""Column expressions on texts and on arrays of lines, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Misread or fused words and what they stand for, applied in this order.
SPACING = {
    "CAMBRIDGEINSTITUTE": "CAMBRIDGE INSTITUTE", "OFTECHNOLOGY": "OF TECHNOLOGY", "COMPUTERORGANIZATION": "COMPUTER ORGANIZATION", "PROFESSIONALCOMMUNICATON": "PROFESSIONAL COMMUNICATION",
    "ELEDRO": "ELECTRO", "LABORTORY": "LABORATORY", "SOMNG": "SOLVING", "INTODION": "INTRODUCTION", "COMMUNICATON": "COMMUNICATION", "ETIC": "ETHIC", "DISARETE": "DISCRETE",
    "MATHIEMATICS": "MATHEMATICS", "FUNDARNENTALS": "FUNDAMENTALS", "PROGRANMING": "PROGRAMMING", "DIGTA": "DIGITAL", "ELEDRONICS": "ELECTRONICS", "UNX": "UNIX",
    "DISCRETEMATHEMATICS": "DISCRETE MATHEMATICS", "CPROGRAMMING": "C PROGRAMMING", "HNDI": "HINDI", "HIND1": "HINDI", "HINDI3": "HINDI", "INNIH": "HINDI", "IHNNI": "HINDI",
}
# Full names of boards and universities.
FULL_NAMES = {
    "VTU": "VISVESVARAYA TECHNOLOGICAL UNIVERSITY",
    "CBSE": "CENTRAL BOARD OF SECONDARY EDUCATION",
    "ICSE": "INDIAN CERTIFICATE OF SECONDARY EDUCATION",
    "SSLC": "KARNATAKA STATE SECONDARY EDUCATION EXAMINATION BOARD",
    "PUC": "DEPARTMENT OF PRE-UNIVERSITY EDUCATION, KARNATAKA",
    "KARNATAKA STATE BOARD": "KARNATAKA STATE SECONDARY EDUCATION EXAMINATION BOARD",
    "KARNATAKA PU BOARD": "DEPARTMENT OF PRE-UNIVERSITY EDUCATION, KARNATAKA",
    "KARNATAKA PU BOARD (NEW)": "KARNATAKA SCHOOL EXAMINATION AND ASSESSMENT BOARD, BENGALURU",
}
# Number words.
ONES = {"ZERO": 0, "ONE": 1, "TWO": 2, "THREE": 3, "FOUR": 4, "FIVE": 5, "SIX": 6, "SEVEN": 7, "EIGHT": 8, "NINE": 9, "TEN": 10, "ELEVEN": 11, "TWELVE": 12, "THIRTEEN": 13, "FOURTEEN": 14, "FIFTEEN": 15, "SIXTEEN": 16, "SEVENTEEN": 17, "EIGHTEEN": 18, "NINETEEN": 19}
TENS = {"TWENTY": 20, "THIRTY": 30, "FORTY": 40, "FIFTY": 50, "SIXTY": 60, "SEVENTY": 70, "EIGHTY": 80, "NINETY": 90}
NUMBER_WORDS = ONES | TENS
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def let(x: Column, use) -> Column:
    """use(x), with x computed once a row and held once in the plan however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def joined(lines: Column) -> Column:
    """All lines as one text in capitals."""
    return F.upper(F.array_join(lines, " "))


def has_any(x: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])


def has_all(x: Column, words) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(x, F.lit(w)) for w in words])


def found(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null if there is none."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def all_found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def numbers(x: Column, pattern: str = r"(?<![0-9A-Za-z_])[0-9]{1,3}(?![0-9A-Za-z_])") -> Column:
    return F.transform(all_found(x, pattern), lambda n: n.cast("int"))


def first_where(lines: Column, test) -> Column:
    """The first element that passes, null if none does."""
    return F.get(F.filter(lines, test), F.lit(0))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def most_frequent(xs: Column, least: int = 1) -> Column:
    """The most frequent element, the first met among equals, null below `least` occurrences."""
    counted = let(xs, lambda a: F.transform(F.array_distinct(a), lambda v: F.struct((-F.size(F.filter(a, lambda w: w == v))).alias("n"), F.array_position(a, v).alias("at"), v.alias("v"))))
    return let(F.get(F.array_sort(counted), F.lit(0)), lambda best: F.when(-best["n"] >= least, best["v"]))


def mode_in(words: Column, least: int = 1) -> Column:
    """Struct (word, n) of the most frequent of many elements, the first met among equals, null below `least`
    occurrences: one pass over the sorted elements, so it suits whole texts where most_frequent() suits a few."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    run = lambda w, at, n: F.struct(w.alias("w"), at.alias("at"), n.alias("n"))
    none = run(F.lit(None).cast("string"), F.lit(0), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        same = x["w"].eqNullSafe(s["now"]["w"])
        now = run(x["w"], F.when(same, s["now"]["at"]).otherwise(x["i"]), F.when(same, s["now"]["n"] + 1).otherwise(1))
        better = (now["n"] > s["best"]["n"]) | ((now["n"] == s["best"]["n"]) & (now["at"] < s["best"]["at"]))
        return F.struct(now.alias("now"), F.when(better, now).otherwise(s["best"]).alias("best"))

    best = F.aggregate(placed, F.struct(none.alias("now"), none.alias("best")), step, lambda s: s["best"])
    return let(best, lambda b: F.when(b["n"] >= least, F.struct(b["w"].alias("word"), b["n"].cast("long").alias("n"))))


def repair_spacing(x: Column) -> Column:
    """Mend fused and misread words of a text in capitals."""
    for wrong, right in SPACING.items():
        x = F.replace(x, F.lit(wrong), F.lit(right))
    x = F.regexp_replace(x, r"([A-Z])(OF|AND|FOR|THE)\b", "$1 $2")
    x = F.regexp_replace(x, r"([A-Z])(INSTITUTE|COLLEGE|TECHNOLOGY|UNIVERSITY)\b", "$1 $2")
    return clean(x)


def full_name(x: Column) -> Column:
    known = F.create_map(*[F.lit(w) for pair in FULL_NAMES.items() for w in pair])
    short = F.upper(clean(x))
    return F.coalesce(F.try_element_at(known, short), short)


def number_in_words(x: Column) -> Column:
    """The first number spelt out in a text in capitals: tens and ones are added, HUNDRED multiplies,
    AND is passed over, any other word after the number ends it. Null if there is none."""
    values = F.create_map(*[v for w, n in NUMBER_WORDS.items() for v in (F.lit(w), F.lit(n))])
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("on"), F.lit(False).alias("over"))

    def step(s: Column, w: Column) -> Column:
        n = F.try_element_at(values, w)
        kind = F.when(s["over"], "skip").when((w == "HUNDRED") & s["on"], "hundred").when(n.isNotNull(), "number").when(w == "AND", "skip").when(s["on"], "end").otherwise("skip")
        total = F.when(kind == "hundred", s["sum"] * 100).when(kind == "number", s["sum"] + n).otherwise(s["sum"])
        return F.struct(total.alias("sum"), (s["on"] | (kind == "number")).alias("on"), (s["over"] | (kind == "end")).alias("over"))

    return F.aggregate(all_found(x, "[A-Z]+"), start, step, lambda s: F.when(s["on"], s["sum"]))


def obtained_mark(nums: Column, in_words: Column) -> Column:
    """The mark among a line's numbers: spelt out, if there are fewer than three; a lone maximum or zeros
    are none; else the last number up to 200."""
    spelt = F.when((F.size(nums) < 3) & in_words.between(0, 200), in_words)
    tail = last(nums)
    usable = F.exists(nums, lambda n: n != 0) & tail.between(0, 200) & ~((F.size(nums) == 1) & tail.isin(100, 125, 150))
    return F.coalesce(spelt, F.when(usable, tail))


def title(x: Column) -> Column:
    """Each run of letters with a capital first, as in O'Neil A.B."""
    cased = lambda chars: F.transform(chars, lambda c, i: F.when((i > 0) & F.regexp_like(F.get(chars, i - 1), F.lit(r"\p{L}")), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(let(F.split(x, ""), cased), "")
