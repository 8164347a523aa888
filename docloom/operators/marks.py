"""Numbers of a marksheet that single expressions can find: totals, averages, register numbers, colleges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import MONTHS, all_found, clean, first_where, found, has_all, has_any, joined, last, let, most_frequent, repair_spacing

_NUMBER = r"(?<![0-9A-Za-z_])[0-9]{3,4}(?![0-9A-Za-z_])"
_USN = "[1I][A-Z]{2}[0-9]{2}[A-Z]{2,3}[A-Z0-9]{2,3}"
# How register numbers are labelled, in this order.
REGISTER_LABELS = (
    r"(?:[A-Z0-9\-/]*\s?)?R[ECG]G?IST?ER(?:\.?\s?N[O0]\.?)?[:\-\s]*([A-Z0-9\-/]{5,20})",
    r"(?:[A-Z0-9\-/]*\s?)?R[O0]L{0,2}\.?\s?N[O0]\.?[:\-\s]*([A-Z0-9\-/]{5,20})",
    r"\bUSN[:\-\s]*([A-Z0-9\-/]{5,20})",
    r"\bSEAT\s?N[O0]\.?[:\-\s]*([A-Z0-9\-/]{5,20})",
    r"\bUNIQUE\s?I?D[:\-\s]*([A-Z0-9\-/]{5,20})",
)
FULL_MONTHS = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")


def _within(x: Column, low: int) -> Column:
    return F.filter(F.transform(all_found(x, _NUMBER), lambda n: n.cast("int")), lambda n: n.between(low, 1500))


def total_parts(lines: Column) -> tuple[Column, Column]:
    """The total that a line names, or one of the next two gives, and every number that could be one."""
    # Words of lines on a total, and of lines on other totals.
    up = F.transform(lines, lambda x: F.regexp_replace(F.upper(x), "([0-9]{3,4})([0-9]{3})([0-9]{3})", "$1 $2 $3"))
    rows = F.transform(up, lambda x, i: F.struct(x.alias("x"), F.get(up, i + 1).alias("next"), F.get(up, i + 2).alias("after")))
    named = F.filter(rows, lambda r: (has_any(r["x"], ("TOTAL", "GRAND")) | F.regexp_like(r["x"], F.lit("T[O0A]TAL"))) & ~has_any(r["x"], ("MAX", "MIN", "SUBJECT", "SCHOLASTIC", "INTERNAL", "EXTERNAL")))
    by_label = F.transform(named, lambda r: F.coalesce(last(_within(r["x"], 100)), last(_within(r["next"], 200)), last(_within(r["after"], 200))))
    return first_where(by_label, lambda v: v.isNotNull()), _within(F.array_join(up, " "), 200)


def total_marks(lines: Column) -> Column:
    """The grand total: the last number of a line that names it, or of the next two; else the most
    frequent number that could be one, if it occurs twice; else the last."""
    named, every = total_parts(lines)
    return F.coalesce(named, most_frequent(every, 2), last(every))


def gpa(lines: Column) -> Column:
    """Grade averages by their labels; where one is missing and both are named, the last two decimals."""
    t = joined(lines)
    labelled = [found(t, rf"{w}\s?[:\-]?\s?([0-9]{{1,2}}\.[0-9]{{1,3}})", 1) for w in ("SGPA", "CGPA")]
    decimals = all_found(t, r"(?<![0-9A-Za-z_])[0-9]{1,2}\.[0-9]{1,3}(?![0-9A-Za-z_])")
    both = has_all(t, ("SGPA", "CGPA")) & (F.size(decimals) >= 2)
    return F.struct(F.coalesce(labelled[0], F.when(both, F.try_element_at(decimals, F.lit(-2)))).cast("double").alias("sgpa"), F.coalesce(labelled[1], F.when(both, last(decimals))).cast("double").alias("cgpa"))


def register(lines: Column) -> Column:
    """Register number and its kind (USN or REG_NO), or, only without one, the semester."""
    t = joined(lines)
    with_digit = lambda v: F.when(F.regexp_like(v, F.lit("[0-9]")), v)
    labelled = F.coalesce(*[with_digit(F.trim(found(t, p, 1))) for p in REGISTER_LABELS])
    months = "|".join(MONTHS)
    top = F.upper(F.array_join(F.slice(lines, 1, 15), " "))
    alone = let(found(top, r"(?<![0-9A-Za-z_])(?=[A-Z0-9]*[0-9])[A-Z0-9]{5,15}(?![0-9A-Za-z_])"), lambda x: F.when(~has_any(x, FULL_MONTHS), x))
    bare_usn = found(t, rf"(?<![0-9A-Za-z_]){_USN}(?![0-9A-Za-z_])")
    long_number = found(t, r"(?<![0-9A-Za-z_])20[0-9]{9}(?![0-9A-Za-z_])")
    by_month = most_frequent(all_found(t, rf"([0-9]{{5,7}})\s?(?:{months})", 1))
    term = found(t, r"(?:SEM(?:ESTER)?|SESSION)\s?[:\-]?\s?\b([0-9IVX]{1,2})\b", 1)
    digits = lambda x: F.regexp_like(x, F.lit("^[0-9]+$"))
    semester = let(term, lambda x: F.when(~digits(x) | (F.try_to_number(x, F.lit("99")) <= 12), x))

    def chosen(k: Column) -> Column:
        usn = F.when(k["labelled"].isNotNull(), F.regexp_like(k["labelled"], F.lit("^" + _USN))).otherwise(k["earlier"].isNull() & k["bare"].isNotNull())
        value = F.coalesce(k["labelled"], k["earlier"], k["bare"], k["alone"])
        mended = F.when(usn & F.startswith(value, F.lit("I")), F.concat(F.lit("1"), F.substring(value, 2, 100))).otherwise(value)
        return F.struct(mended.alias("number"), F.when(value.isNotNull(), F.when(usn, "USN").otherwise("REG_NO")).alias("kind"), F.when(value.isNull(), k["semester"]).alias("semester"))

    kinds = F.struct(labelled.alias("labelled"), F.coalesce(long_number, by_month).alias("earlier"), bare_usn.alias("bare"), alone.alias("alone"), semester.alias("semester"))
    return let(kinds, chosen)


# Words about colleges.
BLOCKED = ("GOVERNMENT OF", "KARNATAKA SCHOOL", "CERTIFY", "CANDIDATE", "OBTALN", "OBTAÍN", "OBTA1N", "CLASS OBTAIN", "TWO HUNDRED", "THREE HUNDRED", "FOUR HUNDRED", "ONLY", "TOTAL", "MARKS")
COLLEGE = ("COLLEGE", "INSTITUTE", "TECHNOLOGY", "ACADEMY", "POLYTECHNIC", "SCHOOL", "VIDYALAYA", "UNIVERSITY", "ENGINEERING", "CAMPUS")
UNIVERSITY = ("VISVESVARAYA", "TECHNOLOGICAL", "BELAGAVI", "STATE BOARD", "PRE-UNIVERSITY", "EXAMINATION AND ASSESSMENT")
SKIPPED = ("REGISTER", "MARKS", "STATEMENT", "GRADE", "USN", "ROLL", "DATE", "RESULT", "PAGE", "B.E.", "B.TECH", "M.TECH", "BACHELOR", "MASTER", "DEGREE", "BRANCH", "COURSE", "SCHEME", *FULL_MONTHS, "CERTIFICATE OF", "EXAMINATION", "CERTIFY", "BOARD OF SECONDARY", "CENTRAL BOARD", "SEAT NUMBER", "SEAT NO", "STUDENT NAME", "PROVISIONAL RESULT", "SEMESTER", "CLASS OBTAIN", "CLASS OBTALN", "OBTALN", "OBTAÍN", "OBTA1N")
CITIES = ("MANGALURU", "MANGALORE", "BELAGAVI", "BELGAUM", "BENGALURU", "BANGALORE", "MYSORE", "MYSURU", "HUBLI", "DHARWAD", "KALABURAGI", "GULBARGA", "SHIVAMOGGA")
SAFE_IN_NAME = ("ICSE", "CBSE", "SSLC", "PUC", "VTU")


def clean_college(x: Column) -> Column:
    # What comes before or is misread in names of colleges, removed in this order.
    x = F.trim(F.regexp_replace(x, r"(?i)^(?:NAME\sO[FT]\sTHE\s)?(?:COLLEGE|INSTITUTE|OFFICE|DEPARTMENT|SCHOOL)[:\-\s]*", ""))
    x = F.regexp_replace(x, r"^(?s)(.{0,15}?)[0-9]{3,6}-\s*", "")
    x = F.regexp_replace(x, "([A-Za-z])([0-9]+)([A-Za-z])", "$1 $2 $3")
    x = F.regexp_replace(x, r"(?i)^OF\s+", "")
    x = F.regexp_replace(x, r"^(?=[A-Z0-9#\-.]*[0-9])[A-Z0-9#\-.]{4,}(?::?\s*[A-Z0-9#\-.]+)?\s*,\s*", "")
    x = F.regexp_replace(x, r"(?i)^.*?DRDADDRND.*?(?:,\s*|\s+)", "")
    return clean(repair_spacing(x))


def college(lines: Column, board: Column) -> Column:
    """The college: next to a line on college details; else the first of the top lines that names one, with
    the next line if that gives a city or postal code."""
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.upper(x).alias("u"), F.get(lines, i - 1).alias("before"), F.get(lines, i + 1).alias("next")))
    fit = lambda x: F.when((F.length(F.trim(x)) > 5) & ~F.regexp_like(F.trim(x), F.lit(r"^[0-9\s,/.]+$")) & ~has_any(F.upper(x), BLOCKED) & F.regexp_like(x, F.lit("[A-Za-z]{4,}")), F.trim(x))
    beside = F.transform(F.filter(rows, lambda r: has_any(r["u"], ("COLLEGE DETAILS", "COLLEGE CODE"))), lambda r: F.coalesce(fit(r["before"]), fit(r["next"])))
    top = F.filter(
        F.slice(rows, 1, 15),
        lambda r: ~F.coalesce((F.length(board) > 0) & F.contains(r["u"], board) & ~board.isin(*SAFE_IN_NAME), F.lit(False))
        & (~has_any(r["u"], UNIVERSITY) | has_any(r["u"], ("COLLEGE", "INSTITUTE", "ACADEMY", "ENGINEERING")))
        & has_any(r["u"], COLLEGE) & ~has_any(r["u"], SKIPPED) & (F.length(F.trim(r["x"])) > 8),
    )
    local = lambda r: (r["i"] < 14) & (has_any(F.upper(r["next"]), CITIES) | F.regexp_like(r["next"], F.lit(r"(?<![0-9A-Za-z_])[0-9]{6}(?![0-9A-Za-z_])")))
    full = F.transform(top, lambda r: F.when(F.coalesce(local(r), F.lit(False)), F.concat(F.regexp_replace(F.trim(r["x"]), ",+$", ""), F.lit(", "), F.regexp_replace(F.trim(r["next"]), "^,+", ""))).otherwise(r["x"]))
    return clean_college(F.coalesce(first_where(beside, lambda v: v.isNotNull()), F.get(full, F.lit(0))))


def fill_single_missing(subjects: Column, total: Column) -> Column:
    """Give the only subject without marks what the others leave of the total, if that is 0 to 200; each subject says whether it was adjusted so."""
    known = F.aggregate(F.filter(subjects, lambda s: s["marks"].isNotNull()), F.lit(0), lambda a, s: a + s["marks"])
    one = F.size(F.filter(subjects, lambda s: s["marks"].isNull())) == 1
    rest = total - known
    derived = lambda s: s["marks"].isNull() & one & rest.between(0, 200)
    return F.transform(subjects, lambda s: s.withField("adjusted", F.coalesce(derived(s), F.lit(False))).withField("marks", F.when(derived(s), rest).otherwise(s["marks"])))
