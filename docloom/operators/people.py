"""Names on a marksheet, and names and marks agreed on by two recognitions of it."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fuzzy import ratio_of
from ..functions.text import MONTHS
from ..schema import SUBJECTS
from .sheets import CORE

# Labels and words around names.
NOISE = ("ADDRESS", "PHOTO", "DATE", "PLACE", "SIGNATURE", "OFFICE", "STAMP", "COLLEGE", "INSTITUTE", "UNIVERSITY", "USN", "US NO", "REGISTER", "FATHWER", "MOTHWR", "STDONT")
STUDENT_LABELS = ("NAME OF THE STUDENT", "NAME OF THE CANDIDATE", "STUDENT NAME", "CANDIDATE'S NAME", "CANDIDATE NAME", "NME OF THE STUDENT", "NME OF THE CANDIDATE", "NME CT HE STDONT", "NME CT HE STUDENT")
NOT_STUDENT = ("FATHER", "MOTHER", "FATHWER", "MOTHWR", "SCHOOL", "BOARD", "UNIVERSITY", "COLLEGE", "INSTITUTE", "OFFICE", "SUBJECT")
NEXT_NOISE = ("DATE", "RESULT", "MARKS", "TOTAL", "REGISTER", "MONTH")
ABOVE_STUDENT = ("GOVERNMENT", "KARNATAKA", "BOARD", "DEPARTMENT", "CERTIFICATE", "EXAMINATION", "REGISTER", "DATE", "RESULF", "RESULT", "MARKS", "TOTAL", "MOTHER", "FATHER")
ABOVE_PARENT = ("GOVERNMENT", "KARNATAKA", "BOARD", "DEPARTMENT", "CERTIFICATE", "EXAMINATION", "REGISTER", "DATE", "MOTHER", "FATHER", "NAME", "CANDIDATE")
HEADER_WORDS = ["SUBJECTS", "SUBJECT", "LANGUAGES", "LANGUAGE", "OPTIONALS", "OPTIONAL", "PARTICULARS", "REGISTER", "MONTH", "YEAR", "MARKS", "OBTAINED", "FIGURES", "WORDS", "TOTAL", "MAXIMUM", "BOARD", "UNIVERSITY", "COLLEGE", "DEPARTMENT", "EXAMINATION", "CERTIFICATE", "CANDIDATE", "STUDENT", "PRINCIPAL", "DIRECTOR", "SIGNATURE"]
PARENTS = {"father": (re.compile("FATHER|HUSBAND|FATHWER"), ("FATHER", "FATHERS"), "MOTHER"), "mother": (re.compile("MOTHER"), ("MOTHER", "MOTHERS"), "FATHER")}


def like_header(text: str) -> bool:
    return any(ratio_of(w, h) >= 0.6 for w in re.findall("[A-Z]{6,}", text.upper()) for h in HEADER_WORDS)


def _like_label(word: str, labels) -> bool:
    return word != "MONTH" and any(word[0] == label[0] and ratio_of(word, label) >= 0.72 for label in labels)


def _label_end(up: str, exact: re.Pattern, labels) -> int | None:
    if m := exact.search(up):
        return m.end()
    return next((m.end() for m in re.finditer("[A-Z]{4,}", up) if _like_label(m[0], labels)), None)


def _before_noise(text: str) -> str:
    up = text.upper()
    cuts = [up.index(n) for n in NOISE if n in up]
    return text[: min(cuts)].strip() if cuts else text.strip()


def _last_two(text: str) -> str:
    words = text.split()
    return " ".join(words[-2:]) if len(words) > 3 else text


def _next_line(line: str, noise) -> str:
    text = re.sub(r"^[\s:.\-,]+", "", line.strip())
    fine = len(text) >= 3 and re.search("[A-Za-z]{2}", text) and not re.search("[a-z]{4}", text) and not any(n in text.upper() for n in noise)
    return text if fine else ""


def _above(lines: list[str], k: int, skip, shape: str):
    """Up to three lines above that may be a name, nearest first."""
    for line in lines[max(0, k - 3) : k][::-1]:
        text = line.strip()
        if not any(w in text.upper() for w in skip) and re.fullmatch(shape, text) and len(text.split()) <= 6:
            yield text


def _student_at(lines: list[str], k: int) -> tuple[str, bool] | None:
    """A student's name at a line that names one, and whether the label is a full one."""
    up = lines[k].upper()
    if not re.search(r"NAME|NME|\bNAM\b|NAM$", up) or any(w in up for w in NOT_STUDENT) or "GOVERNMENT" in up:
        return None
    if re.search(r"\bM[O0]B?ERS\b|\bF[A4]THERS?\b", up) or any(_like_label(w, ("FATHER", "FATHERS", "MOTHER", "MOTHERS")) for w in re.findall("[A-Z]{4,}", up)):
        return None
    label = next((x for x in STUDENT_LABELS if x in up), None)
    following = lines[k + 1] if k + 1 < len(lines) else ""
    wordy = lambda t: len(t) >= 3 and re.search("[A-Z]{2}", t)
    if label:
        after, before = up.rpartition(label)[2].replace(":", "").strip(), up.partition(label)[0].strip()
        name = next((t for t in (after, before) if wordy(t)), "") or _next_line(following, NEXT_NOISE)
        if not name:
            name = next(_above(lines, k, ABOVE_STUDENT, r"[A-Za-z\s.]{3,40}"), "")
            words = name.split()
            if len(words) >= 2 and len(words[0]) <= 2 and len(words[-1]) >= 4:
                name = " ".join(words[1:])
    else:
        # The words that end a name behind a short label.
        m = re.search(r"(?:NAME|NAM)\s?[:\-]?\s?([A-Z][A-Z\s]{2,40}?)(?=\s+(?:MARKS|TOTAL|RESULT|INTERNAL|EXTERNAL|SUBJECT|SEMESTER|DATE)\b|$)", up)
        name = m[1].strip() if m else ""
        if not name and len(up) <= 25:
            name = _next_line(following, (*NEXT_NOISE, "MOTHER", "FATHER", "NAME"))
    name = re.sub("^[LIJ](?=[A-Z]{8,})", "", re.sub(r"^[\s:.\-,]+", "", name).strip())
    name = _before_noise(name)
    return (name, bool(label) or any(x in up for x in ("NAME:", "NAME OF", "NME:"))) if len(name) >= 3 else None


def _parent_at(lines: list[str], k: int, kind: str) -> str | None:
    exact, labels, other = PARENTS[kind]
    up = lines[k].upper()
    end = _label_end(up, exact, labels)
    if end is None:
        return None
    rest = up[end:]
    named = re.search("NA[MN]E?", rest[:40])
    rest = rest[named.end() :] if named else re.sub(r"^['\s]*S?\s*", "", rest)
    rest = _before_noise(re.sub(r"^[:\-\s]+", "", rest))
    if len(rest) >= 3 and re.search("[A-Z]{3}", rest):
        return _last_two(rest)
    following = _before_noise(lines[k + 1]) if k + 1 < len(lines) else ""
    if len(following) >= 3 and re.search("[A-Za-z]{2}", following) and other not in following.upper() and not like_header(following):
        return _last_two(following)
    return next((t for t in map(_last_two, _above(lines, k, ABOVE_PARENT, r"[A-Za-z0-9\s.]{3,40}")) if re.search("[A-Za-z]{3}", t) and not like_header(t)), None)


def _without_title(text: str) -> str:
    if " " in text[:6]:
        first, _, rest = text.partition(" ")
        return rest.strip() if len(first) <= 4 else text
    return next((text[n:] for n in (3, 4) if len(text) > n + 3 and text[n].isalpha()), text)


def people_of(lines: list[str]) -> tuple[str | None, str | None, str | None]:
    """Student, father and mother of a marksheet. Full labels win over others, later over earlier ones."""
    student, certain = None, False
    parents: dict[str, str | None] = {"father": None, "mother": None}
    for k, line in enumerate(lines):
        if (got := _student_at(lines, k)) and (student is None or got[1]):
            student, certain = got[0], certain or got[1]
        if student is None and (m := re.search(r"CERTIFY(?:ING)?\s+THAT\s+(?!THE\b)([A-Z][A-Z\s]{2,40}?)(?=\s+(?:ROLL|MOTHER|FATHER|DATE|SCHOOL|HAS|IS)\b|$)", line.upper())):
            student = m[1].strip() if len(m[1].strip()) >= 3 else None
        for kind in parents:
            parents[kind] = _parent_at(lines, k, kind) or parents[kind]
    ups = [x.strip().upper() for x in lines]
    fine = lambda t: t if len(t) >= 3 and re.search("[A-Z]{2}", t) else None
    if None in parents.values():
        child = next((k for k, u in enumerate(ups) if re.search(r"\b(?:SON|DAUGHTER) OF\b", u) and k + 1 < len(ups)), None)
        if child is not None:
            parents["mother"] = parents["mother"] or fine(_without_title(ups[child + 1]))
            if child + 2 < len(ups):
                parents["father"] = parents["father"] or fine(_without_title(ups[child + 2]))
        for kind, mark in (("father", "SHRI"), ("mother", "SMT")):
            for u in ups:
                if parents[kind] is None and re.match(rf"{mark}\b", u):
                    parents[kind] = fine(re.sub(rf"^{mark}\b[:\-\s]*", "", u).strip())
    tidy = lambda t: " ".join(t.split()) if t else None
    return tidy(student), tidy(parents["father"]), tidy(parents["mother"])


# Agreement of two recognitions

# Words of the header zone that belong to no name.
STOP_WORDS = frozenset(["MONTH", "YEAR", "NAME", "CANDIDATE", "CANDIDATES", "REGISTER", "MOTHER", "FATHER", "MOTHERS", "FATHERS", "HUSBAND", "CERTIFICATE", "EXAMINATION", "EDUCATION", "DEPARTMENT", "GOVERNMENT", "DETAILS", "PASSED", "COMPLETED", "KARNATAKA", "UNIVERSITY", "SECOND", "COURSE"])
STOP_PHRASES = ("THIS IS TO", "FOLLOWING DETAILS", "SECOND YEAR", "PRE-UNIVERSITY", "PRE UNIVERSITY", "SCHOOL EXAMINATION", "MARKS STATEMENT")
ZONE_END = ["ENGLISH", "HINDI", "KANNADA", "SANSKRIT", "URDU", "TAMIL", "TELUGU", "MATHEMATICS", "MATHS", "PHYSICS", "CHEMISTRY", "BIOLOGY", "COMPUTER", "HISTORY", "GEOGRAPHY", "ECONOMICS", "POLITICAL", "SOCIOLOGY", "ACCOUNTANCY", "BUSINESS", "ELECTRONICS"]
_WHEN = re.compile(rf"(?:{'|'.join(MONTHS)})[A-Z]*\s?20\d{{2}}")


def _zone(lines: list[str]) -> list[str]:
    ups = [x.strip().upper() for x in lines]
    return ups[: next((k for k, u in enumerate(ups) if any(s in u for s in ZONE_END)), 20)]


def longest_common_run(a: list[str], b: list[str]) -> list[str]:
    """The longest run of elements that both have, the first in a of equals."""
    best = (0, 0)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        longest = max(row)
        if longest > best[0]:
            best = (longest, i)
    return a[best[1] - best[0] : best[1]]


def consensus(lines_a: list[str], lines_b: list[str], missing: list[str], known: list[str]) -> dict[str, str]:
    """Names that both recognitions of a header agree on, for the fields that miss one."""
    zones = _zone(lines_a), _zone(lines_b)
    seen = [k.strip().upper() for k in known if k]
    fresh = lambda t: all(ratio_of(t, k) < 0.8 for k in seen)
    out: dict[str, str] = {}
    if "student_name" in missing:
        before = []
        for zone in zones:
            hit = next((u[: m.start()] for u in zone if (m := _WHEN.search(u))), "")
            before.append([w for w in re.findall("[A-Z]{1,15}", hit) if w not in STOP_WORDS])
        name = " ".join(run := longest_common_run(*before))
        if sum(map(len, run)) >= 3 and fresh(name):
            out["student_name"] = name
            seen.append(name)
    wanted = [f for f in ("mother_name", "father_name") if f in missing]
    if wanted:
        lists = []
        for zone in zones:
            after = next((k + 1 for k, u in enumerate(zone) if _WHEN.search(u)), 0)
            plain = (" ".join(re.sub(r"[^A-Z\s]", "", u).split()) for u in zone[after:] if 0 < len(u) <= 35 and not _WHEN.search(u) and not any(p in u for p in STOP_PHRASES))
            lists.append([t for t in plain if len(t) >= 3 and not any(w in t.replace(" ", "") for w in STOP_WORDS)])
        left = Counter(lists[1])
        agreed = []
        for t in lists[0]:
            if len(t) >= 4 and re.search("[AEIOU]", t) and fresh(t) and left[t] > 0:
                left[t] -= 1
                agreed.append(t)
        out |= dict(zip(wanted, agreed, strict=False))
    return out


# Marks of two recognitions


def core_key(name: str) -> str:
    """The longest core subject in a name, so that SCIENCE and SOCIAL SCIENCE stay apart; else the name."""
    return max((c for c in CORE if c in name.upper()), key=len, default=name.upper())


def same_subject(a: str, b: str) -> bool:
    a, b = a.upper(), b.upper()
    x, y = core_key(a), core_key(b)
    return a == b or x == y or (x not in CORE and y not in CORE and (a in b or b in a)) or ratio_of(a, b) >= 0.75


def merged(subjects: list[dict], other: list[dict]) -> list[dict]:
    """Subjects of one recognition with marks filled from another; if that has further subjects with
    marks, they are put in, in its order, what only the first has at the end."""
    def filled(s: dict) -> dict:
        found = next((o for o in other if o["marks"] is not None and same_subject(s["subject"], o["subject"])), None) if s["marks"] is None else None
        return dict(s) if found is None else s | {k: found[k] for k in ("marks", "marks_raw", "adjusted") if k in found}

    out = [filled(s) for s in subjects]
    new = [o for o in other if o["marks"] is not None and o["subject"] and not any(same_subject(s["subject"], o["subject"]) for s in out)]
    if not new:
        return out
    rest, ordered = dict(enumerate(out)), []
    for o in other:
        if not o["subject"]:
            continue
        k = next((k for k, s in rest.items() if same_subject(s["subject"], o["subject"])), None)
        if k is not None:
            ordered.append(rest.pop(k))
        elif o["marks"] is not None:
            ordered.append(dict(o))
    return ordered + list(rest.values())


NAMES = T.StructType([T.StructField(n, T.StringType()) for n in ("student_name", "father_name", "mother_name")])


def _list(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(NAMES)
def people(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([people_of([x or "" for x in _list(t)]) for t in lines], columns=NAMES.names)


@F.pandas_udf(NAMES)
def agreed_names(a: pd.Series, b: pd.Series, missing: pd.Series, known: pd.Series) -> pd.DataFrame:
    got = [consensus(_list(x), _list(y), _list(m), _list(k)) for x, y, m, k in zip(a, b, missing, known, strict=True)]
    return pd.DataFrame([[g.get(n) for n in NAMES.names] for g in got], columns=NAMES.names)


@F.pandas_udf(SUBJECTS)
def merge_subjects(subjects: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([merged([dict(s) for s in _list(a)], [dict(s) for s in _list(b)]) for a, b in zip(subjects, other, strict=True)])


COMPLETED = T.StructType([T.StructField("subjects", SUBJECTS), T.StructField("total", T.IntegerType())])


def completed(subjects: list[dict], other: list[dict], total: int | None) -> tuple[list[dict], int | None]:
    """Merge a second recognition; a missing total becomes the sum if marks were found, and a single mark
    that is still missing what the others leave of the total."""
    lost = sum(s["marks"] is None for s in subjects)
    out = merged(subjects, other)
    missing = [s for s in out if s["marks"] is None]
    known = sum(s["marks"] or 0 for s in out)
    if total is None and len(missing) < lost:
        total = known
    if total is not None and len(missing) == 1 and 0 <= total - known <= 200:
        missing[0] |= {"marks": total - known, "marks_raw": None, "adjusted": True}
    return out, total


@F.pandas_udf(COMPLETED)
def complete_subjects(subjects: pd.Series, other: pd.Series, total: pd.Series) -> pd.DataFrame:
    got = [completed([dict(s) for s in _list(a)], [dict(s) for s in _list(b)], None if pd.isna(t) else int(t)) for a, b, t in zip(subjects, other, total, strict=True)]
    return pd.DataFrame({"subjects": [g[0] for g in got], "total": pd.array([g[1] for g in got], "Int32")})
