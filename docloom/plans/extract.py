"""From recognised documents to typed fields: classify, refuse, read by class, recover from a second pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, full_name, has_any, joined
from ..operators import identity, marks, people, sheets
from ..operators.classify import board as board_of
from ..operators.classify import document_class, reject_reason
from ..operators.lines import lines_of
from .stages import checkpointed

TYPES = {
    "aadhaar": "struct<name:string,date_of_birth:string,year_of_birth:string,gender:string,aadhaar_number:string>",
    "pan": "struct<name:string,father_name:string,pan_number:string,date_of_birth:string>",
    "driving_license": "struct<dl_number:string,name:string,dob:string>",
    "marksheet": "struct<student_name:string,father_name:string,mother_name:string,college_name:string,subjects:array<struct<subject:string,marks:int,certainty:string,additional:boolean,marks_raw:int,adjusted:boolean>>,total_marks:int,sgpa:double,cgpa:double,university:string,board:string,semester:string,usn:string,register_number:string>",
}


def with_class(documents: DataFrame) -> DataFrame:
    """Documents (schema.DOCUMENT) with texts, document_type and reject_reason."""
    texts = F.transform("tokens", lambda t: t["text"])
    seen = documents.withColumn("texts", F.coalesce(texts, F.array().cast("array<string>"))).withColumn("document_type", document_class(F.col("texts")))
    return seen.withColumn("reject_reason", reject_reason(F.col("mime"), F.col("length"), F.col("height").isNotNull(), F.col("center_std"), F.size("texts"), F.col("document_type")))


def marksheet(lines: Column) -> list[tuple[str, Column]]:
    """The steps of reading a marksheet, as columns that build on each other."""
    c = F.col
    has_total = F.exists(lines, lambda x: has_any(F.upper(x), ("TOTAL", "GRAND")) & ~(F.contains(F.upper(x), F.lit("SUBJECT")) & F.contains(F.upper(x), F.lit("CODE"))) & F.regexp_like(x, F.lit("(?<![0-9A-Za-z_])[0-9]{3,}(?![0-9A-Za-z_])")))
    graded = has_any(joined(lines), ("GRADE CARD", "SGPA", "CGPA", "CREDIT"))
    usn_kind = c("reg.kind") == "USN"
    university = F.coalesce(usn_kind, F.lit(False)) | F.coalesce(has_any(c("board1"), ("UNIVERSITY", "VTU")), F.lit(False))
    return [
        ("sheet", sheets.sheet(lines, board_of(lines), *marks.total_parts(lines), has_total, graded)),
        ("board1", c("sheet.board")),
        ("reg", marks.register(lines)),
        ("people", people.people(lines)),
        ("gpa", marks.gpa(lines)),
        ("college", F.when(c("board1") == "KARNATAKA STATE BOARD", marks.college(lines, F.lit("KARNATAKA STATE BOARD"))).when(F.coalesce(c("board1") != "VTU", F.lit(True)), marks.college(lines, board_of(lines)))),
        ("is_university", university),
        (
            "marksheet",
            F.struct(
                c("people.student_name"), F.when(~F.coalesce(c("board1") == "VTU", F.lit(False)), c("people.father_name")).alias("father_name"), F.when(~F.coalesce(c("board1") == "VTU", F.lit(False)), c("people.mother_name")).alias("mother_name"),
                clean(c("college")).alias("college_name"), c("sheet.subjects"), c("sheet.total").alias("total_marks"), c("gpa.sgpa"), c("gpa.cgpa"),
                F.when(c("is_university"), full_name(F.lit("VTU"))).alias("university"),
                F.when(~c("is_university") | ~has_any(c("board1"), ("VTU", "UNIVERSITY")), full_name(c("board1"))).alias("board"), c("reg.semester"),
                F.when(c("is_university"), c("reg.number")).alias("usn"), F.when(~c("is_university"), c("reg.number")).alias("register_number"),
            ),
        ),
    ]


def extract(documents: DataFrame) -> DataFrame:
    """Typed fields: document_type, reject_reason and one struct per class, the others null.

    One pass: a document is classified once, and each reader gets the lines of its own class and nulls for the
    rest. Nothing shuffles.
    """
    seen = with_class(documents)
    kind = F.when(F.col("reject_reason").isNull(), F.col("document_type"))
    seen = seen.withColumn("kind", kind)
    of = lambda name, x: F.when(F.col("kind") == name, x)
    rows = seen.withColumn("lines", F.coalesce(of("Marksheet", lines_of(F.col("tokens"), F.col("height"), F.col("width"))), F.col("texts")))
    texts = lambda name: of(name, F.col("texts"))
    rows = rows.withColumns(
        {
            "aadhaar": of("Aadhaar", identity.aadhaar(texts("Aadhaar"))),
            "pan": of("PAN", identity.pan(texts("PAN"), of("PAN", identity.reading_order(F.col("tokens"))))),
            "driving_license": of("Driving License", identity.driving_licence(texts("Driving License"))),
            "sheet_lines": of("Marksheet", F.col("lines")),
        }
    )
    for name, column in marksheet(F.col("sheet_lines")):
        rows = rows.withColumn(name, column)
    rows = rows.withColumn("marksheet", of("Marksheet", F.col("marksheet")))
    return rows.select("doc_id", "pass_no", "document_type", "reject_reason", "lines", *[F.col(n).cast(t).alias(n) for n, t in TYPES.items()])


def letters(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z]", "")


def implausible(x: Column) -> Column:
    return F.length(letters(x)) <= 3


def needs_second_pass(sheet: Column) -> Column:
    """Whether a marksheet misses marks or names, names the student like a parent, or doesn't add up."""
    subjects = F.coalesce(sheet["subjects"], F.array().cast(TYPES["marksheet"].split("subjects:")[1].split(",total")[0]))
    missing = F.exists(subjects, lambda s: s["marks"].isNull())
    summed = F.aggregate(subjects, F.lit(0), lambda a, s: a + F.coalesce(s["marks"], F.lit(0)))
    vtu = F.coalesce(has_any(sheet["university"], ("VISVESVARAYA", "VTU")), F.lit(False))
    names = implausible(sheet["student_name"]) | (~vtu & (implausible(sheet["father_name"]) | implausible(sheet["mother_name"])))
    student = letters(sheet["student_name"])
    doubled = (student != "") & ((student == letters(sheet["father_name"])) | (student == letters(sheet["mother_name"])))
    off = F.coalesce((F.size(subjects) > 0) & ~missing & (summed != sheet["total_marks"]), F.lit(False))
    return missing | names | doubled | off


def recover(first: DataFrame, second: DataFrame) -> DataFrame:
    """Marksheets of a first pass completed by those of a second (both as from extract), one row per
    document of the first; documents that miss nothing don't meet the join."""
    first, second = checkpointed(first), checkpointed(second)
    need = F.col("marksheet").isNotNull() & needs_second_pass(F.col("marksheet"))
    again = second.where("marksheet is not null").select("doc_id", F.col("marksheet").alias("m2"), F.col("lines").alias("lines2"))
    todo = first.where(need).join(again, "doc_id", "left")
    m, m2 = F.col("marksheet"), F.col("m2")

    def better(field: str) -> Column:
        now, then = m[field], m2[field]
        a, b = F.trim(F.regexp_replace(F.upper(now), "[^A-Z ]", "")), F.trim(F.regexp_replace(F.upper(then), "[^A-Z ]", ""))
        related = (a != b) & (F.endswith(a, b) | F.endswith(b, a))
        out = F.when(F.coalesce(now, F.lit("")) == "", F.coalesce(then, now)).when(related, F.when((F.length(b) > F.length(a)) & (F.length(b) >= 3), then).otherwise(now))
        out = out.when(implausible(now) & ~implausible(then), then)
        if field == "student_name":
            parent = lambda x: F.coalesce(reduce(lambda p, q: p | q, [(letters(x) != "") & (letters(x) == letters(s[f])) for s in (m, m2) for f in ("father_name", "mother_name")]), F.lit(False))
            out = out.when(then.isNotNull() & parent(now) & ~parent(then), then)
        return out.otherwise(now)

    vtu = F.coalesce(has_any(m["university"], ("VISVESVARAYA", "VTU")), F.lit(False))
    todo = todo.withColumn("full", people.complete_subjects(m["subjects"], m2["subjects"], m["total_marks"]))
    todo = todo.withColumns({f: F.when(vtu & (F.lit(f) != "student_name"), m[f]).otherwise(better(f)) for f in ("student_name", "father_name", "mother_name")})
    fields = ("student_name", "father_name", "mother_name")
    open_ = F.filter(F.array(*[F.when(implausible(F.col(f)) & (~vtu | F.lit(f == "student_name")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    sure = F.filter(F.array(*[F.when(~implausible(F.col(f)), F.col(f)) for f in fields]), lambda f: f.isNotNull())
    todo = todo.withColumn("agreed", people.agreed_names(F.col("lines"), F.col("lines2"), open_, sure))
    sheet = m.withField("subjects", F.col("full.subjects")).withField("total_marks", F.col("full.total"))
    for f in fields:
        sheet = sheet.withField(f, F.when(implausible(F.col(f)), F.coalesce(F.col("agreed")[f], F.col(f))).otherwise(F.col(f)))
    done = todo.withColumn("marksheet", sheet.cast(TYPES["marksheet"])).select(first.columns)
    return first.where(~need | F.col("marksheet").isNull()).unionByName(done)
