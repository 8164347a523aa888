"""Fields of identity cards: national identity letters, tax cards and driving licences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import ratio_of
from ..functions.text import all_found, first_where, found, has_any, joined, let, title

# Words that no holder's name has.
NOT_A_NAME = [
    "government", "india", "unique", "identification", "authority", "aadhaar", "dob", "year", "yob", "male", "female", "father", "mother", "husband", "wife", "address", "s/o",
    "d/o", "w/o", "vill", "dist", "state", "pin", "help", "download", "generated", "issue", "rural", "urban", "road", "cross", "main", "street", "lane", "layout", "nagar",
    "colony", "block", "sector", "phase", "near", "opp", "behind", "district", "disict", "bengaluru", "bangalore", "vid", "crop", "adjust", "edit", "share", "send", "delete",
    "lens", "more", "favourite", "file", "scan", "page", "search", "menu", "home", "back",
]
CARD_DATES = ("issue", "generated", "download", "print", "update")
DATE = r"[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}"
YEAR = r"(?<![0-9A-Za-z_])(?:19|20)[0-9]{2}(?![0-9A-Za-z_])"


def _low(x: Column) -> Column:
    return F.lower(x)


def aadhaar_number(lines: Column) -> Column:
    """The first twelve digits that stand alone in a line, spaces left out."""
    return F.get(F.filter(F.transform(lines, lambda x: found(F.replace(x, F.lit(" "), F.lit("")), r"(?<![0-9A-Za-z_])[0-9]{12}(?![0-9A-Za-z_])")), lambda x: x.isNotNull()), F.lit(0))


def gender(lines: Column) -> Column:
    line = first_where(lines, lambda x: F.contains(_low(x), F.lit("male")))
    return F.when(F.contains(_low(line), F.lit("female")), "Female").when(line.isNotNull(), "Male")


def _indexed(lines: Column) -> Column:
    """Lines with what stands around them."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(lines, i - 1).alias("before"), F.get(lines, i + 1).alias("next")))


def _first_value(items: Column, value) -> Column:
    return F.get(F.filter(F.transform(items, value), lambda v: v.isNotNull()), F.lit(0))


def birth_date(lines: Column) -> Column:
    """Date, or year, of birth: by a label in its line or the next; near the gender; any date that is not
    one of the card's own; a year in a line about birth; a year in a short line by the gender."""
    return let(_indexed(lines), _born_among)


def _born_among(all_lines: Column) -> Column:
    own_date = lambda t: has_any(_low(t["x"]), (*CARD_DATES, "gov", "india")) | F.coalesce(has_any(_low(t["before"]), CARD_DATES), F.lit(False))
    usable = F.filter(all_lines, lambda t: ~own_date(t))
    gendered = F.filter(all_lines, lambda t: F.contains(_low(t["x"]), F.lit("male")))
    labelled = F.filter(all_lines, lambda t: has_any(_low(t["x"]), ("dob", "d0b", "date of birth", "जन्म", "year of birth")))
    about = F.filter(all_lines, lambda t: has_any(_low(t["x"]), ("year", "yob", "birth")))

    def beside(reach: int, value) -> Column:
        return _first_value(F.flatten(F.transform(gendered, lambda g: F.filter(usable, lambda t: F.abs(t["i"] - g["i"]) <= reach))), value)

    return F.coalesce(
        _first_value(labelled, lambda t: F.coalesce(found(t["x"], DATE), found(t["next"], DATE), found(t["x"], YEAR))),
        beside(3, lambda t: found(t["x"], DATE)),
        _first_value(usable, lambda t: found(t["x"], DATE)),
        _first_value(about, lambda t: found(t["x"], "(?:19|20)[0-9]{2}")),
        beside(1, lambda t: F.when(F.length(t["x"]) < 20, found(t["x"], YEAR))),
    )


def _name_like(x: Column) -> Column:
    return ~has_any(_low(x), NOT_A_NAME) & F.regexp_like(x, F.lit(r"^[A-Z][A-Za-z\s.'-]{2,}$")) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 3)


def holder_name(lines: Column) -> Column:
    """The holder's name: below a line `To`; else between heading and birth or gender, from the latter
    upward; without a heading up to six lines above, then two below. Title case, a fused initial apart."""
    rows = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    return let(rows, _holder_among)


def _holder_among(rows: Column) -> Column:
    low = lambda t: _low(t["x"])
    stop = F.coalesce(F.get(F.filter(rows, lambda t: has_any(low(t), ("dob", "year", "male", "female", "s/o", "w/o"))), F.lit(0))["i"], F.size(rows))
    head = let(stop, lambda s: F.try_element_at(F.filter(rows, lambda t: (t["i"] <= s) & has_any(low(t), ("government", "india", "aadhaar"))), F.lit(-1))["i"])
    foot = F.get(F.filter(rows, lambda t: has_any(low(t), ("dob", "date of birth", "year of birth", "yob", "male", "female"))), F.lit(0))["i"]
    good = F.filter(rows, lambda t: _name_like(t["x"]))

    def name(known: Column) -> Column:
        head, foot, good = known["head"], known["foot"], known["good"]
        candidate = F.filter(good, lambda t: ~F.startswith(low(t), F.lit("name")))
        to = F.filter(rows, lambda t: low(t).isin("to", "to,"))
        addressed = F.get(F.flatten(F.transform(to, lambda r: F.filter(good, lambda t: t["i"].between(r["i"] + 1, r["i"] + 3)))), F.lit(0))["x"]
        up = lambda low_, high: F.try_element_at(F.filter(candidate, lambda t: (t["i"] > low_) & (t["i"] < high)), F.lit(-1))["x"]
        down = lambda low_, high: F.get(F.filter(candidate, lambda t: (t["i"] > low_) & (t["i"] < high)), F.lit(0))["x"]
        inside = F.when(head < foot, up(head, foot)).otherwise(down(foot, head))
        around = F.coalesce(up(foot - 7, foot), down(foot, foot + 3))
        return F.coalesce(addressed, F.when(head.isNotNull() & foot.isNotNull(), inside).when(foot.isNotNull(), around))

    found_name = let(F.struct(head.alias("head"), foot.alias("foot"), good.alias("good")), name)
    return title(F.regexp_replace(found_name, "([a-z])([A-Z])$", "$1 $2"))


def aadhaar(lines: Column) -> Column:
    year = lambda born: F.regexp_like(born, F.lit("^[0-9]{4}$"))
    born = let(birth_date(lines), lambda b: F.struct(F.when(~year(b), b).alias("date"), F.when(year(b), b).alias("year")))
    return F.struct(holder_name(lines).alias("name"), born["date"].alias("date_of_birth"), born["year"].alias("year_of_birth"), gender(lines).alias("gender"), aadhaar_number(lines).alias("aadhaar_number"))


SPACED_DL = r"(?<![0-9A-Za-z_])[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}(?![0-9A-Za-z_])"


def licence_number(lines: Column) -> Column:
    t = joined(lines)
    tight = lambda x: F.regexp_replace(x, "[- ]", "")
    return F.coalesce(found(tight(t), "[A-Z]{2}[0-9]{13,14}"), tight(found(t, SPACED_DL)))


def licence_birth_date(lines: Column) -> Column:
    """The date by its label, else the one of the earliest year, the first of equals."""
    t = joined(lines)
    dates = all_found(t, r"(?<![0-9A-Za-z_])[0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4}(?![0-9A-Za-z_])")
    by_year = F.array_sort(F.transform(dates, lambda d, i: F.struct(F.right(d, F.lit(4)).cast("int").alias("y"), i.alias("i"), d.alias("d"))))
    return F.coalesce(found(t, r"D\.?O\.?B\.?\s*[:\-.]?\s*([0-9]{2}[/\-.][0-9]{2}[/\-.][0-9]{4})", 1), F.get(by_year, F.lit(0))["d"])


# What ends a name on a licence, and what no name line has.
STOP = r"(?:S/D|S/O|D/O|W/O|S/D/W|SON|DAUGHTER|WIFE|D\.O\.B|DOB|D\.0\.B|ADDRESS|ADD\s|ADD\.|PIN|SIGNATURE|B\.G\.|VALID|SEE RULE|RULE|\[S|COV|MCWG|LMV|DOI|[0-9]{2}/[0-9]{2}/[0-9]{4})"
BOILERPLATE = r"(?i)(?:ADDRESS|ADD\s|ADD\.|S/O|D/O|W/O|S/D|SON OF|DAUGHTER OF|WIFE OF|D\.O\.B|DOB|SIGNATURE|\bSIGN\b|\bHOLDER\b|\bFORM\b|PIN\b|PINCODE|VALID|SEE RULE|\bRULE\b|COV\b|MCWG|\bLMV\b|\bDOI\b|RTO|LICEN[CS]E|AUTHORITY|TRANSPORT|GOVT|GOVERNMENT|\bINDIA\b|REPUBLIC|DRIVING)"


def _undated(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?s)[:\s-]*[0-9]{2}/[0-9]{2}/[0-9]{4}.*$", ""))


def _bare(x: Column) -> Column:
    return _undated(F.regexp_replace(x, "^[:\\-•= ]+", ""))


def licence_name(lines: Column) -> Column:
    """The name after its label up to a word that ends it; else the first line that looks like a name."""
    labelled = _bare(found(F.array_join(lines, " "), rf"(?i)NAME\s*[:-]?\s*(.+?)(?=\s+{STOP}|$)", 1))
    none = F.array().cast("array<string>")

    def below(t: Column) -> Column:
        """What a line with the label and those after it give, up to one that ends the name."""
        rest = F.slice(lines, t["i"] + 2, F.size(lines))
        until = F.array_position(F.transform(rest, lambda x: F.regexp_like(x, F.lit("(?i)" + STOP))), True)
        upto = F.when(until > 0, (until - 1).cast("int")).otherwise(F.size(rest))
        parts = F.filter(F.transform(F.slice(rest, F.lit(1), upto), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) | F.endswith(x, F.lit(".")))
        same = _undated(F.trim(F.replace(F.regexp_extract(t["x"], "(?is)NAME(.*)$", 1), F.lit(":"), F.lit(""))))
        return F.array_join(F.concat(F.when(F.length(same) > 1, F.array(same)).otherwise(none), F.filter(F.transform(parts, _bare), lambda x: x != "")), " ")

    named = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda t: F.contains(F.upper(t["x"]), F.lit("NAME")))
    gathered = F.get(F.filter(F.transform(named, below), lambda x: x != ""), F.lit(0))
    words = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    letters = lambda x: F.length(F.regexp_replace(F.trim(x), r"[^\p{L}]", ""))
    like = lambda x: words(x).between(2, 5) & ~F.regexp_like(x, F.lit(BOILERPLATE)) & ~F.regexp_like(x, F.lit("[0-9]")) & (letters(x) >= F.length(F.trim(x)) * 0.8)
    return F.coalesce(let(labelled, lambda x: F.when(F.length(x) >= 2, x)), gathered, F.trim(first_where(lines, like)))


def driving_licence(lines: Column) -> Column:
    return F.struct(licence_number(lines).alias("dl_number"), licence_name(lines).alias("name"), licence_birth_date(lines).alias("dob"))


PAN_NUMBER = r"(?<![0-9A-Za-z_])[A-Z]{5}[0-9]{4}[A-Z](?![0-9A-Za-z_])"
SLASH_DATE = r"(?<![0-9A-Za-z_])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z_])"


def pan_number(lines: Column) -> Column:
    return F.get(F.filter(F.transform(lines, lambda x: found(x, PAN_NUMBER)), lambda x: x.isNotNull()), F.lit(0))


def pan_birth_date(lines: Column) -> Column:
    return F.get(F.filter(F.transform(lines, lambda x: found(x, SLASH_DATE)), lambda x: x.isNotNull()), F.lit(0))


def reading_order(tokens: Column) -> Column:
    """Texts of a tax card's tokens from top to bottom; if over three in ten stand upright, across the
    page, from the right unless the heading is left of the middle."""
    axis = lambda t, k: F.transform(t["box"], lambda p: p[k])
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b) / 4
    span = lambda xs: F.array_max(xs) - F.array_min(xs)
    boxes = F.transform(tokens, lambda t: F.struct(mean(axis(t, 1)).alias("y"), mean(axis(t, 0)).alias("x"), span(axis(t, 0)).alias("w"), span(axis(t, 1)).alias("h"), t["pos"].alias("pos"), t["text"].alias("text")))
    upright = F.size(F.filter(boxes, lambda b: b["h"] > b["w"] * 1.5)) > F.size(boxes) * 0.3
    heading = F.get(F.filter(boxes, lambda b: has_any(F.upper(b["text"]), ("INCOME", "ACCOUNT"))), F.lit(0))["x"]
    middle = F.get(F.array_sort(F.transform(boxes, lambda b: b["x"])), F.floor(F.size(boxes) / 2).cast("int"))
    sign = F.when(heading < middle, 1).otherwise(-1)
    order = F.transform(boxes, lambda b: F.struct(F.when(upright, b["x"] * sign).otherwise(b["y"]).alias("k"), b["pos"].alias("pos"), b["text"].alias("text")))
    return F.transform(F.array_sort(order), lambda b: b["text"])


# Parts of a tax card that are no names.
PAN_NOISE = ("GOVERNMENT", "INCOME", "TAX", "DEPARTMENT", "SIGNATURE", "PERMANENT", "ACCOUNT", "NUMBER", "CARD", "INDIA", "HRROR", "ERROR", "HRD")
_PREFIXES = tuple(map(re.compile, (r"^NAME[:\s]*", r"^FATHER['S]*\s*NAME[:\s]*", r"^S/O[:\s]*", r"^D/O[:\s]*", r"^W/O[:\s]*")))  # each is taken away once, in this order
_LABELS = {"name": re.compile(r"NAME\b"), "father": re.compile(r"FATHER\b|FATHERS\s*NAME\b|FATA\b")}
_HEADING = re.compile(r"INCOME\s*TAX|GOVT\.?\s*OF\s*INDIA|GOVERNMENT\s*OF\s*INDIA")


def _split_double(name: str) -> str:
    return f"{name[:-1]} {name[-1]}" if len(name) > 4 and " " not in name and name[-1] == name[-2] else name


def pan_names_of(texts: list[str], own_number: str | None) -> tuple[str | None, str | None]:
    """Name and father's name among a tax card's texts in reading order.

    Both are looked for between the last heading and the date; where that doesn't give two, next to their
    labels; what is left is filled in order. Positions are places in reading order throughout.
    """
    labels: dict[str, int] = {}
    candidates: list[tuple[int, str]] = []
    heading = date = None
    for i, raw in enumerate(texts):
        up = raw.strip().upper()
        if date is None and re.search(SLASH_DATE, up):
            date = i
        if _HEADING.search(up):
            heading = i
        labels |= {kind: i for kind, pattern in _LABELS.items() if pattern.search(up)}
        similar = [kind for kind, word in (("name", "NAME"), ("father", "FATHER")) if kind not in labels and len(up) <= 10 and " " not in up and ratio_of(up, word) >= 0.6]
        labels |= dict.fromkeys(similar, i)
        if similar:
            continue
        bare = up
        for prefix in _PREFIXES:
            bare = prefix.sub("", bare).strip()
        tight = bare.replace(" ", "")
        wrong = not re.fullmatch(r"[A-Z0-9 .]{2,}", bare) or any(w in bare for w in PAN_NOISE) or tight == own_number or re.fullmatch(r"[A-Z]{5}[0-9]{4}[A-Z]", tight)
        if wrong or (len(bare) > 3 and not re.search("[AEIOUY]", bare)) or (" " not in bare and len(bare) < 3):
            continue
        candidates.append((i, _split_double(bare)))

    inside = [text for i, text in candidates if heading is not None and heading < i < (len(texts) if date is None else date)]
    name, father = [*inside, None, None][:2]
    if name is None or father is None:
        left = sorted(candidates, key=lambda c: " " not in c[1])
        taken: dict[str, str] = {}
        for kind in ("name", "father"):
            if kind in labels and left:
                taken[kind] = min(left, key=lambda c: abs(c[0] - labels[kind]))[1]
                left = [c for c in left if c[1] != taken[kind]]
        if taken or len(left) >= 2:
            for kind in ("name", "father"):
                if kind not in taken and left:
                    taken[kind] = left.pop(0)[1]
        name, father = name or taken.get("name"), father or taken.get("father")
    return tuple(_split_double(n.upper()).title() if n else None for n in (name, father))


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("father_name", T.StringType())]))
def pan_names(texts: pd.Series, number: pd.Series) -> pd.DataFrame:
    got = [pan_names_of(list(t) if t is not None else [], n) for t, n in zip(texts, number, strict=True)]
    return pd.DataFrame(got, columns=["name", "father_name"])


def pan(lines: Column, texts: Column | None = None) -> Column:
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    number = pan_number(trimmed)
    names = pan_names(trimmed if texts is None else texts, number)
    return F.struct(names["name"].alias("name"), names["father_name"].alias("father_name"), number.alias("pan_number"), pan_birth_date(trimmed).alias("date_of_birth"))
