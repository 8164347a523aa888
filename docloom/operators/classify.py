"""Which document a text is: ordered rule tables as single expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_all, has_any, joined

KNOWN = ("Aadhaar", "PAN", "Driving License", "Marksheet")
MIME_TYPES = ("image/jpeg", "image/png", "image/bmp", "image/tiff", "image/webp", "image/jpg")
MOST_BYTES = 20 * 1024 * 1024
BLANK_BELOW = 12.0
FEWEST_TEXTS = 3
SSLC = r"S\.?\s*S\.?\s*L\.?\s*C"
# Letters and digits around these must be absent. What begins the match comes first: a look-behind ahead of it is tried at every character.
DL_NUMBER = r"[A-Z](?<![0-9A-Za-z_][A-Z])[A-Z][-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}(?![0-9A-Za-z_])"
TWELVE_DIGITS = r"[0-9](?<![0-9A-Za-z_][0-9])[0-9]{3}\s?[0-9]{4}\s?[0-9]{4}(?![0-9A-Za-z_])"

# Signs of a marksheet; any one is enough.
MARKSHEET_WORDS = ("SSLC", "S.S.L.C", "CBSE", "ICSE", "VISVESVARAYA", "SECONDARY EDUCATION", "MARKS STATEMENT CUM CERTIFICATE", "COUNCIL FOR THE INDIAN SCHOOL", "UNIVERSITY", "OFKARNATAKA", "OF-KARNATAKA", "STATEMENT OF MARKS", "CENTRAL BOARD", "INDIAN CERTIFICATE")


def document_class(lines: Column) -> Column:
    """The class of a document by its lines; the first rule that holds decides."""
    t = joined(lines)
    birth = has_any(t, ("DOB", "YEAR OF BIRTH", "YOB")) & F.contains(t, F.lit("MALE"))
    marksheet = has_any(t, MARKSHEET_WORDS) | F.regexp_like(t, F.lit(SSLC)) | (F.contains(t, F.lit("KARNATAKA")) & has_any(t, ("BOARD", "SECONDARY")))
    rules = (
        (has_any(t, ("AADHAAR", "AADHAR", "UNIQUE IDENTIFICATION", "UIDAI")), "Aadhaar"),
        (F.contains(t, F.lit("GOVERNMENT OF INDIA")) & birth, "Aadhaar"),
        (has_any(t, ("VID :", "VID:")), "Aadhaar"),
        (has_any(t, ("PERMANENT ACCOUNT NUMBER", "INCOME TAX DEPARTMENT")), "PAN"),
        (has_any(t, ("DRIVING LICENCE", "DL NO", "DRIVING LICENSE")) | F.regexp_like(t, F.lit(DL_NUMBER)), "Driving License"),
        (marksheet, "Marksheet"),
        (F.regexp_like(t, F.lit(TWELVE_DIGITS)), "Aadhaar"),
    )
    out = F.lit("Unknown")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def board(lines: Column) -> Column:
    """The examining board of a marksheet, null if none is named."""
    t = joined(lines)
    state = has_any(t, ("SECONDARY EDUCATION", "SSLC")) | F.regexp_like(t, F.lit(SSLC)) | (F.contains(t, F.lit("KARNATAKA")) & has_any(t, ("BOARD", "SECONDARY"))) | has_all(t, ("GOVERNMENT OF KARNATAKA", "KANNADA"))
    return (
        F.when(has_any(t, ("SCHOOL EXAMINATION AND ASSESSMENT", "EXAMINATION AND ASSESSMENT BOARD", "KSEAB")), "KARNATAKA PU BOARD (NEW)")
        .when(has_any(t, ("PRE-UNIVERSITY", "PRE UNIVERSITY", "PUCOLLEGE", "PU COLLEGE")) | has_all(t, ("PUC", "EXAMINATION")), "KARNATAKA PU BOARD")
        .when(has_any(t, ("CBSE", "CENTRAL BOARD")), "CBSE")
        .when(has_any(t, ("ICSE", "INDIAN CERTIFICATE", "COUNCIL FOR THE INDIAN SCHOOL")), "ICSE")
        .when(state, "KARNATAKA STATE BOARD")
        .when(has_any(t, ("UNIVERSITY", "VTU", "VISVESVARAYA")), "VTU")
    )


def reject_reason(mime: Column, length: Column, decoded: Column, center_std: Column, n_texts: Column, kind: Column) -> Column:
    """Why an upload is refused, by the first check it fails; null if it passes all."""
    bad_type = (F.coalesce(mime, F.lit("")) != "") & ~mime.isin(*MIME_TYPES) & ~F.startswith(mime, F.lit("image/"))
    return (
        F.when(bad_type, "unsupported_type").when(length == 0, "empty_file").when(length > MOST_BYTES, "too_large").when(~decoded, "not_an_image")
        .when(center_std < BLANK_BELOW, "blank_image").when(n_texts < FEWEST_TEXTS, "too_little_text").when(~kind.isin(*KNOWN), "unknown_document")
    )


def new_style_aadhaar(lines: Column, height: Column, width: Column) -> Column:
    """A letter with the card in it: upright page, or an address side with an enrolment number."""
    to = F.exists(lines, lambda x: F.upper(F.trim(x)).isin("TO", "TO,"))
    return (height > width * 1.15) | (to & F.contains(joined(lines), F.lit("ENROLMENT")))


def classify(documents: DataFrame, lines: str = "lines") -> DataFrame:
    return documents.withColumn("document_type", document_class(F.col(lines)))
