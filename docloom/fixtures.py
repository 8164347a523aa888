"""Invented rows for the document rules; no real person, number or institution's record is among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# id, lines, class; one row per rule and some that nearly meet one.
CLASSES = [
    (1, ["your aadhaar letter"], "Aadhaar"), (2, ["Unique Identification", "test"], "Aadhaar"), (3, ["Government of India", "DOB 01/01/2000", "FEMALE"], "Aadhaar"),
    (4, ["Government of India", "DOB 01/01/2000"], "Unknown"), (5, ["VID: 0000"], "Aadhaar"), (6, ["signed DAVID: test"], "Aadhaar"), (7, ["INCOME TAX DEPARTMENT"], "PAN"),
    (8, ["Permanent Account Number"], "PAN"), (9, ["DRIVING LICENCE"], "Driving License"), (10, ["dl no 5"], "Driving License"), (11, ["KA-00 2000 0000000"], "Driving License"),
    (12, ["KA0020000000000 x"], "Driving License"), (13, ["XKA0020000000000"], "Unknown"), (14, ["S.S. LC"], "Marksheet"), (15, ["CBSE"], "Marksheet"), (16, ["secondary education"], "Marksheet"),
    (17, ["TEST UNIVERSITY"], "Marksheet"), (18, ["karnataka", "board"], "Marksheet"), (19, ["karnataka"], "Unknown"), (20, ["statement of marks"], "Marksheet"), (21, ["Indian Certificate"], "Marksheet"),
    (22, ["0000 0000 0000"], "Aadhaar"), (23, ["000000000000"], "Aadhaar"), (24, ["00000000000"], "Unknown"), (25, ["0000000000000"], "Unknown"), (26, ["0000 0000 0000 0000"], "Aadhaar"), (27, [], "Unknown"), (28, ["FEMALE"], "Unknown"),
]
# id, mime, length, decoded, center_std, n_texts, kind, reason
UPLOADS = [
    (1, "image/png", 10, True, 20.0, 5, "PAN", None), (2, None, 10, True, 20.0, 5, "PAN", None), (3, "", 10, True, 20.0, 5, "PAN", None), (4, "image/x-own", 10, True, 20.0, 5, "PAN", None),
    (5, "text/plain", 0, False, 1.0, 0, "Unknown", "unsupported_type"), (6, "image/png", 0, False, 1.0, 0, "Unknown", "empty_file"), (7, "image/png", 20971520, True, 20.0, 5, "PAN", None),
    (8, "image/png", 20971521, True, 20.0, 5, "PAN", "too_large"), (9, "image/png", 5, False, 20.0, 5, "PAN", "not_an_image"), (10, "image/png", 5, True, 11.9, 5, "PAN", "blank_image"),
    (11, "image/png", 5, True, 12.0, 5, "PAN", None), (12, "image/png", 5, True, 20.0, 2, "PAN", "too_little_text"), (13, "image/png", 5, True, 20.0, 3, "Unknown", "unknown_document"), (14, "image/png", 5, True, None, 3, "Marksheet", None),
]
# doc_id, pos, text, x, y, x_end, height, width
TOKENS = [
    (1, 0, "first", 10.0, 10.0, 60.0, 1000, 1000), (1, 1, "row", 70.0, 20.0, 90.0, 1000, 1000), (1, 2, "chained", 100.0, 30.0, 150.0, 1000, 1000), (1, 3, "second", 10.0, 41.0, 60.0, 1000, 1000),
    (1, 4, "far", 261.0, 41.0, 300.0, 1000, 1000), (1, 5, "near", 500.0, 45.0, 550.0, 1000, 1000), (2, 0, "b", 50.0, 0.0, 60.0, 0, 0), (2, 1, "a", 50.0, 15.0, 60.0, 0, 0), (2, 2, "c", 5.0, 31.0, 9.0, 0, 0),
    (3, 0, "late", 30.0, 5.0, 40.0, 300, 100), (3, 1, "early", 0.0, 6.0, 10.0, 300, 100), (3, 2, "gap", 91.0, 6.0, 99.0, 300, 100), (3, 3, "same", 0.0, 6.0, 12.0, 300, 100),
]
TOKEN_SCHEMA = "doc_id long, pos int, text string, x double, y double, x_end double, height int, width int"
# id, lines, board
BOARDS = [
    (1, ["KSEAB"], "KARNATAKA PU BOARD (NEW)"), (2, ["School Examination and Assessment"], "KARNATAKA PU BOARD (NEW)"), (3, ["pre-university"], "KARNATAKA PU BOARD"), (4, ["PUC", "examination"], "KARNATAKA PU BOARD"),
    (5, ["CBSE"], "CBSE"), (6, ["indian certificate"], "ICSE"), (7, ["SSLC"], "KARNATAKA STATE BOARD"), (8, ["s. s. l. c"], "KARNATAKA STATE BOARD"), (9, ["Karnataka", "Secondary"], "KARNATAKA STATE BOARD"),
    (10, ["Government of Karnataka", "Kannada"], "KARNATAKA STATE BOARD"), (11, ["any university"], "VTU"), (12, ["nothing"], None), (13, [], None),
]
# id, lines, sgpa, cgpa
AVERAGES = [(1, ["SGPA: 8.25", "CGPA 7.5"], 8.25, 7.5), (2, ["SGPA CGPA", "9.10 8.75"], 9.1, 9.1), (3, ["SGPA 6.0"], 6.0, None), (4, ["1.5 2.5"], None, None), (5, ["CGPA", "SGPA-9.5 8.1"], 9.5, 8.1)]
# id, lines, total
TOTALS = [
    (1, ["GRAND TOTAL 600 450"], 450), (2, ["TOTAL", "x", "512"], 512), (3, ["TOTAL MAX 600", "300 301 300"], 300), (4, ["210", "305"], 305), (5, ["410"], 410), (6, ["nothing 12"], None),
    (7, ["T0TAL 150"], 150), (8, ["TOTAL 600450425"], 425), (9, [], None),
]
# id, lines, number, kind, semester
REGISTERS = [
    (1, ["REGISTER NO: AB12345"], "AB12345", "REG_NO", None), (2, ["USN I00CS00AAA1"], "I00CS00AAA1", "REG_NO", None), (3, ["USN: 1AA00CS000"], "1AA00CS000", "USN", None), (4, ["20000000000"], "20000000000", "REG_NO", None),
    (5, ["x 123456 MAR 2000", "654321 MAR", "123456APR"], "123456", "REG_NO", None), (6, ["IAA00CS000"], "1AA00CS000", "USN", None), (7, ["code A1B2C"], "A1B2C", "REG_NO", None), (8, ["SEMESTER: IV"], None, None, "IV"), (9, ["nothing"], None, None, None),
]
# id, lines, name, date_of_birth, year_of_birth, gender, number
LETTERS = [
    (1, ["Government of India", "Test Person", "DOB: 01/02/1990", "MALE", "0000 1111 2222"], "Test Person", "01/02/1990", None, "Male", "000011112222"),
    (2, ["To", "Sample NameM", "12 Any Road", "Year of Birth: 1985", "Female"], "Sample Name M", None, "1985", "Female", None),
    (3, ["Invented Holder", "Date of Birth", "03-04-1999", "Female"], "Invented Holder", "03-04-1999", None, "Female", None),
    (4, ["Issue Date 01/01/2020", "Male", "05/06/1970"], None, "05/06/1970", None, "Male", None),
    (5, ["nothing here"], None, None, None, None, None),
    (6, ["Government of India", "Person Alpha", "12/03/1988"], None, "12/03/1988", None, None, None),
    (7, ["YOB 1977"], None, None, "1977", None, None),
    (8, ["Male", "1969"], None, None, "1969", "Male", None),
]
# id, lines, number, dob, name
LICENCES = [
    (1, ["DRIVING LICENCE", "KA00 20000000000", "Name: TEST PERSON S/D/W of X", "DOB: 01-01-1980"], "KA0020000000000", "01-01-1980", "TEST PERSON"),
    (2, ["DL NO", "01/01/2020 01/01/1970", "Invented Holder"], None, "01/01/1970", "DL NO"),
    (3, ["Name", "FIRST LAST", "ADDRESS"], None, None, "FIRST LAST"),
    (4, ["NAME", "X", "DOB 01/01/1990", "HOLDER NAME", "TEST PERSON", "VALID"], None, "01/01/1990", "TEST PERSON"),
]
# id, texts, number, dob, name, father
CARDS = [
    (1, ["INCOME TAX DEPARTMENT", "GOVT OF INDIA", "TEST PERSON", "OTHER PERSON", "01/01/1990", "AAAAA0000A"], "AAAAA0000A", "01/01/1990", "Test Person", "Other Person"),
    (2, ["Permanent Account Number", "ZZZZZ9999Z", "Name", "TESTT", "Father", "SOME ONE"], "ZZZZZ9999Z", None, "Test T", "Father"),
    (3, ["x"], None, None, None, None),
]
# id, board, lines
SHEETS = [
    (1, "VTU", ["18CS51 MANAGEMENT OF TESTS 35 40 75 P", "AND SAMPLES", "18CS52 NETWORKS 20 30 50 P", "GRAND TOTAL 125"]),
    (2, "VTU", ["15MAT11 ENGINEERING MATHEMATICS", "80 28 45 20 8 18 100 35 63", "15PHY12 PHYSICS 100 35 60"]),
    (3, "KARNATAKA PU BOARD", ["ENGLISH 80 60 20 18 100 78", "PHYSICS", "70 50", "30 28", "100 78"]),
    (4, "KARNATAKA STATE BOARD", ["FIRST LANGUAGE KANNADA 125 44 110", "SECOND LANGUAGE:", "ENGLISH 100 35 88", "MATHEMATICS", "100 35 91", "TOTAL 625 450"]),
    (5, "ICSE", ["ENGLISH", "ENGLISH LANGUAGE 80", "85 EIGHTY FIVE", "MATHEMATICS 91", "HINDI", "77"]),
    (6, None, ["nothing"]),
]
# id, subject, marks, certainty; what the rules read from SHEETS
SHEET_MARKS = [
    (1, "MANAGEMENT OF TESTS AND SAMPLES", 75, "High"), (1, "NETWORKS", 50, "High"), (2, "ENGINEERING MATHEMATICS", 63, "High"), (2, "PHYSICS", 60, "Low"), (3, "ENGLISH", 78, "High"), (3, "PHYSICS", 78, "High"),
    (4, "FIRST LANGUAGE KANNADA", 110, None), (4, "SECOND LANGUAGE ENGLISH", 88, None), (4, "MATHEMATICS", 91, None), (5, "ENGLISH", 85, None), (5, "MATHEMATICS", 91, None), (5, "HINDI", 77, None),
]
# Sheets whose marks are read as 80, 30 and 40: id, last line, marks by subject after they are reconciled, total
UNIVERSITY_SHEET = ["TEST UNIVERSITY", "18CS51 ALGEBRA 35 45 80 P", "18CS52 PRACTICE 10 20 30 P", "18CS53 SYSTEMS 20 20 40 P"]
RECONCILED = [
    (1, "GRAND TOTAL 138", [70, 28, 40], 138), (2, "GRAND TOTAL 162", [90, 32, 40], 162), (3, "GRAND TOTAL 140", [70, 30, 40], 140), (4, "GRAND TOTAL 148", [80, 28, 40], 148), (5, "GRAND TOTAL 149", [79, 30, 40], 149),
    (6, "GRAND TOTAL 147", [77, 30, 40], 147), (7, "GRAND TOTAL 146", [80, 30, 40], 146), (8, "GRAND TOTAL 150", [80, 30, 40], 150), (9, "NOTE", [80, 30, 40], 150),
]
# id, lines, board, college
COLLEGES = [
    (1, ["COLLEGE DETAILS", "TEST SCIENCE COLLEGE, SAMPLE TOWN"], None, "TEST SCIENCE COLLEGE, SAMPLE TOWN"),
    (2, ["STATE BOARD", "SAMPLE INSTITUTEOFTECHNOLOGY,", "MYSORE 000000"], "X", "SAMPLE INSTITUTE OF TECHNOLOGY, MYSORE 000000"),
    (3, ["12345-TEST ACADEMY OF ARTS"], None, "TEST ACADEMY OF ARTS"), (4, ["REGISTER OF SCHOOL", "short"], None, None), (5, ["NAME OF THE COLLEGE: INVENTED POLYTECHNIC"], None, "INVENTED POLYTECHNIC"),
]
# id, lines, student, father, mother
PEOPLE = [
    (1, ["NAME OF THE STUDENT: TEST PERSON", "FATHER'S NAME: OTHER PERSON", "MOTHER'S NAME: THIRD PERSON"], "TEST PERSON", "OTHER PERSON", "THIRD PERSON"),
    (2, ["TEST PERSON", "NAME OF THE CANDIDATE", "12 MARKS"], "TEST PERSON", None, None),
    (3, ["THIS IS TO CERTIFY THAT TEST PERSON HAS PASSED", "SON OF", "SMT ALPHA BETA", "SHRI GAMMA DELTA"], "TEST PERSON", "GAMMA DELTA", "ALPHA BETA"),
    (4, ["nothing here"], None, None, None),
]
# id, lines of one recognition and of another, missing fields, known names, student, father, mother agreed on
AGREED = [
    (1, ["TEST PERSON MAR 2020", "OTHERA", "OTHERA", "THIRDE", "ENGLISH 90"], ["XX TEST PERSON MAR 2020", "OTHERA", "THIRDE", "ENGLISH 90"], ["student_name", "mother_name", "father_name"], [], "TEST PERSON", "THIRDE", "OTHERA"),
    (2, ["TEST PERSON MAR 2020", "OTHERA", "ENGLISH 90"], ["TEST PERSON MAR 2020", "OTHERA", "ENGLISH 90"], ["student_name"], ["TEST PERSON"], None, None, None),
]
# id, lines, height, width, whether the letter is of the new style
LETTER_STYLES = [(1, ["To", "Enrolment No 1"], 100, 100, True), (2, ["x"], 116, 100, True), (3, ["x"], 114, 100, False), (4, ["To me", "ENROLMENT"], 100, 100, False), (5, ["to,", "enrolment"], 100, 100, True)]
# id, box, factor, the box in the page's pixels
SCALED = [
    (1, [[10.0, 20.0], [30.0, 20.0], [30.0, 40.0], [10.0, 40.0]], 2.0, [[5.0, 10.0], [15.0, 10.0], [15.0, 20.0], [5.0, 20.0]]), (2, [[10.0], [30.0, 20.0], [30.0, 40.0], [10.0, 40.0]], 2.0, [[0.0, 0.0], [15.0, 10.0], [15.0, 20.0], [5.0, 20.0]]),
    (3, [[10.0, 20.0], [30.0, 20.0], [30.0, 40.0]], 2.0, [[0.0, 0.0]] * 4), (4, None, 0.5, [[0.0, 0.0]] * 4),
]
# id, tokens (text, x, y, width, height), texts in reading order: an upright card, cards turned to either side
TURNED = [
    (1, [("SECOND", 0, 50, 90, 10), ("INCOME TAX", 0, 10, 90, 10), ("THIRD", 0, 90, 90, 10)], ["INCOME TAX", "SECOND", "THIRD"]),
    (2, [("THIRD", 100, 0, 10, 90), ("INCOME TAX", 300, 0, 10, 90), ("SECOND", 200, 0, 10, 90)], ["INCOME TAX", "SECOND", "THIRD"]),
    (3, [("THIRD", 250, 0, 10, 90), ("SECOND", 150, 0, 10, 90), ("INCOME TAX", 50, 0, 10, 90)], ["INCOME TAX", "SECOND", "THIRD"]),
    (4, [("LEFT", 10, 0, 10, 90), ("RIGHT", 90, 0, 10, 90)], ["RIGHT", "LEFT"]),
]
# id, text, mended text, full name of a board
SPACINGS = [(1, "CPROGRAMMING LABORTORY", "vtu"), (2, "INSTITUTEOFTECHNOLOGY", "Puc "), (3, "DISCRETEMATHEMATICS  AND HIND1", "other"), (4, "plain", "ICSE"), (5, "ELEDRONICSAND UNX  FORTHE", "SSLC")]
# id, text, value
SPELT = [(1, "NINETY FIVE", 95), (2, "ONE HUNDRED AND TWO", 102), (3, "MARKS SEVEN EIGHT ONLY NINE", 15), (4, "HUNDRED", None), (5, "TWO HUNDRED TEN", 210), (6, "", None)]
# id, subjects (name, marks), other subjects, expected
PASSES = [
    (1, [("SCIENCE", None), ("ENGLISH", 80)], [("SCIENCE", 70), ("ENGLISH", 81)], [("SCIENCE", 70), ("ENGLISH", 80)]),
    (2, [("SOCIAL SCIENCE", None)], [("SCIENCE", 55)], [("SCIENCE", 55), ("SOCIAL SCIENCE", None)]),
    (3, [("HINDI", 60), ("ENGLISH", None)], [("KANNADA", 50), ("ENGLSH", 90), ("HINDI", 61)], [("KANNADA", 50), ("ENGLISH", 90), ("HINDI", 60)]),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(v) -> str:
    """A value as both Spark SQL and DuckDB read it, arrays in DuckDB's way."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list) and (not v or isinstance(v[0], str)):
        return "CAST([" + ", ".join(map(literal, v)) + "] AS VARCHAR[])"
    if isinstance(v, list):
        return "[" + ", ".join(map(literal, v)) + "]"
    return repr(v)


def values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS f({names})"
