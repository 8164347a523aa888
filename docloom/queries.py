"""The registered queries on recognised documents and their SQL counterparts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import tables
from .functions import text as tx
from .operators import classify, identity, marks, metrics, people, relational, sheets
from .operators.lines import group_lines, lines_of, unscale_boxes
from .plans.extract import extract, marksheet, recover
from .schema import DOCUMENT
from .sources.records import as_json, masked


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in fewer pieces than there are tasks, dealt to all of them; a table in many pieces stays as it is."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows if rows.rdd.getNumPartitions() >= n else rows.repartition(n)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as arrays of lines."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


def classify_documents(spark, sf_dir):
    rows = fx.frame(spark, [(-i, x) for i, x, _ in fx.CLASSES], "doc_id long, lines array<string>").unionByName(_lines(spark, sf_dir))
    return classify.classify(rows).select("doc_id", "document_type")


def class_counts(spark, sf_dir):
    return classify_documents(spark, sf_dir).groupBy("document_type").agg(F.count("*").alias("n"))


def reject_reasons(spark, sf_dir):
    rows = fx.frame(spark, [r[:7] for r in fx.UPLOADS], "id long, mime string, length long, decoded boolean, center_std double, n_texts int, kind string")
    return rows.select("id", classify.reject_reason(*[F.col(c) for c in ("mime", "length", "decoded", "center_std", "n_texts", "kind")]).alias("reason"))


def lines_min_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.size("lines").cast("long").alias("n_lines")).where(F.col("n_lines") >= classify.FEWEST_TEXTS)


def grouped_lines(spark, sf_dir):
    return group_lines(fx.frame(spark, fx.TOKENS, fx.TOKEN_SCHEMA)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


def _documents(spark) -> DataFrame:
    """The token fixture as documents with one array of tokens each."""
    rows: dict[int, list] = {}
    for d, pos, text, x, y, x_end, h, w in fx.TOKENS:
        rows.setdefault(d, [d, "image/png", 10, h, w, 20.0, 1, []])[7].append((pos, text, [[x, y], [x_end, y], [x_end, y + 8], [x, y + 8]], 0.9))
    return spark.createDataFrame([tuple(r) for r in rows.values()], DOCUMENT)


def grouped_lines_array(spark, sf_dir):
    lines = lines_of(F.col("tokens"), F.col("height"), F.col("width"))
    return _documents(spark).select("doc_id", F.posexplode(lines).alias("line_no", "line")).select("doc_id", (F.col("line_no") + 1).cast("long").alias("line_no"), "line")


def line_marks(spark, sf_dir):
    each = _lines(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("line_no", "line"))
    each = each.where(F.regexp_like("line", F.lit("[0-9]"))).withColumn("nums", tx.numbers(F.col("line"))).where(F.size("nums") > 0)
    return each.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("nums").cast("long").alias("n"), tx.last(F.col("nums")).cast("long").alias("last"), tx.obtained_mark(F.col("nums"), F.lit(None).cast("int")).cast("long").alias("mark"))


def decimal_pairs(spark, sf_dir):
    found = tx.all_found(tx.joined(F.col("lines")), r"(?<![0-9A-Za-z_])[0-9]{1,2}\.[0-9]{1,3}(?![0-9A-Za-z_])")
    return _lines(spark, sf_dir).withColumn("d", found).where(F.size("d") >= 2).select("doc_id", F.try_element_at("d", F.lit(-2)).alias("next_to_last"), tx.last(F.col("d")).alias("last"))


def long_digit_ids(spark, sf_dir):
    rows = fx.frame(spark, [(-r[0], r[1]) for r in fx.LETTERS], "doc_id long, lines array<string>").unionByName(_lines(spark, sf_dir))
    tight = F.replace(F.array_join("lines", "\n"), F.lit(" "), F.lit(""))
    return rows.select("doc_id", identity.aadhaar_number(F.col("lines")).alias("twelve"), F.size(tx.all_found(tight, "[0-9]{16}")).cast("long").alias("sixteens"))


def token_mode(spark, sf_dir):
    """Each document's most frequent word, the first met among equals: words are counted before anything moves, then
    one candidate a document and task does."""
    words = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(tx.all_found(F.col("text"), "[A-Za-z]+")).alias("pos", "word"))
    counted = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.where("n >= 2").groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("low"), "first", "word")).alias("best"))
    return best.select("doc_id", "best.word", (-F.col("best.low")).alias("n"))


def repeated_lines(spark, sf_dir):
    """Lines a document shares with the document of the next id, as bags."""
    lines = _lines(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    after = lines.select((F.col("doc_id") - 1).alias("doc_id"), "pos", "line")
    return relational.ordered_intersection(lines, after, ["doc_id"], "line", "pos").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


SUBJECT_NAMES = ["Social Science", "SCIENCE", "Maths II", "Computer Applications", "Robotics", "FIRST LANGUAGE KANNADA", "art education"]


def core_keys(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in SUBJECT_NAMES], "name string").select("name", relational.core_key(F.col("name")).alias("core"))


def boards(spark, sf_dir):
    rows = fx.frame(spark, [r[:2] for r in fx.BOARDS], "id long, lines array<string>")
    return rows.select("id", classify.board(F.col("lines")).alias("board"))


def grade_averages(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.AVERAGES], "id long, lines array<string>").select("id", marks.gpa(F.col("lines")).alias("g")).select("id", "g.*")


def totals(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.TOTALS], "id long, lines array<string>").select("id", marks.total_marks(F.col("lines")).cast("long").alias("total"))


def registers(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.REGISTERS], "id long, lines array<string>").select("id", marks.register(F.col("lines")).alias("r")).select("id", "r.*")


def spelt_numbers(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.SPELT], "id long, text string").select("id", tx.number_in_words(F.col("text")).cast("long").alias("value"))


def repaired_spacing(spark, sf_dir):
    return fx.frame(spark, fx.SPACINGS, "id long, text string, board string").select("id", tx.repair_spacing(F.col("text")).alias("text"), tx.full_name(F.col("board")).alias("full_name"))


def aadhaar_fields(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.LETTERS], "id long, lines array<string>").select("id", identity.aadhaar(F.col("lines")).alias("a")).select("id", "a.*")


def licence_fields(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.LICENCES], "id long, lines array<string>").select("id", identity.driving_licence(F.col("lines")).alias("d")).select("id", "d.*")


def pan_fields(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.CARDS], "id long, lines array<string>").select("id", identity.pan(F.col("lines")).alias("p")).select("id", "p.*")


def sheet_subjects(spark, sf_dir):
    rows = fx.frame(spark, fx.SHEETS, "id long, board string, lines array<string>")
    return rows.select("id", F.explode(sheets.subjects(F.col("lines"), F.col("board"))).alias("s")).select("id", "s.subject", F.col("s.marks").cast("long").alias("marks"), "s.certainty")


def reconciled_marks(spark, sf_dir):
    """Subjects of a university sheet under several totals, one of them missing."""
    rows = fx.frame(spark, [(i, [*fx.UNIVERSITY_SHEET, end]) for i, end, *_ in fx.RECONCILED], "id long, lines array<string>")
    name, sheet = marksheet(F.col("lines"))[0]
    rows = rows.withColumn(name, sheet).select("id", F.col("sheet.total").cast("long").alias("total"), F.explode("sheet.subjects").alias("s"))
    return rows.select("id", "s.subject", F.col("s.marks").cast("long").alias("marks"), F.col("s.marks_raw").cast("long").alias("marks_raw"), "s.adjusted", "total")


def college_names(spark, sf_dir):
    return fx.frame(spark, [r[:3] for r in fx.COLLEGES], "id long, lines array<string>, board string").select("id", marks.college(F.col("lines"), F.col("board")).alias("college"))


def sheet_people(spark, sf_dir):
    return fx.frame(spark, [r[:2] for r in fx.PEOPLE], "id long, lines array<string>").select("id", people.people(F.col("lines")).alias("p")).select("id", "p.*")


def agreed_names(spark, sf_dir):
    kind = "array<string>"
    rows = fx.frame(spark, [r[:5] for r in fx.AGREED], f"id long, a {kind}, b {kind}, missing {kind}, known {kind}")
    return rows.select("id", people.agreed_names(*[F.col(c) for c in ("a", "b", "missing", "known")]).alias("n")).select("id", "n.*")


def letter_styles(spark, sf_dir):
    rows = fx.frame(spark, [r[:4] for r in fx.LETTER_STYLES], "id long, lines array<string>, height int, width int")
    return rows.select("id", classify.new_style_aadhaar(F.col("lines"), F.col("height"), F.col("width")).alias("new_style"))


def unscaled_boxes(spark, sf_dir):
    rows = fx.frame(spark, [(i, [(0, "x", box, None)], f) for i, box, f, _ in fx.SCALED], "id long, tokens array<struct<pos:int,text:string,box:array<array<double>>,conf:double>>, factor double")
    rows = rows.select("id", F.explode(unscale_boxes(F.col("tokens"), F.col("factor"))).alias("t")).select("id", "t.conf", F.posexplode("t.box").alias("k", "p"))
    return rows.select("id", F.col("k").cast("long").alias("k"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "conf")


def reading_orders(spark, sf_dir):
    box = lambda x, y, w, h: [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    rows = [(i, [(k, t, box(*at), 0.9) for k, (t, *at) in enumerate(tokens)]) for i, tokens, _ in fx.TURNED]
    df = fx.frame(spark, rows, "id long, tokens array<struct<pos:int,text:string,box:array<array<double>>,conf:double>>")
    return df.select("id", F.posexplode(identity.reading_order(F.col("tokens"))).alias("place", "text")).select("id", F.col("place").cast("long").alias("place"), "text")


def _subjects(pairs):
    return [(n, m, None, False) for n, m in pairs]


def merged_subjects(spark, sf_dir):
    kind = "array<struct<subject:string,marks:int,certainty:string,additional:boolean>>"
    rows = fx.frame(spark, [(i, _subjects(a), _subjects(b)) for i, a, b, _ in fx.PASSES], f"id long, a {kind}, b {kind}")
    return rows.select("id", F.posexplode(people.merge_subjects(F.col("a"), F.col("b"))).alias("pos", "s")).select("id", F.col("pos").cast("long").alias("pos"), "s.subject", F.col("s.marks").cast("long").alias("marks"))


def single_missing(spark, sf_dir):
    rows = [(1, [("A", 50), ("B", None)], 120), (2, [("A", 50), ("B", None), ("C", None)], 120), (3, [("A", 50), ("B", None)], 300), (4, [("A", 50), ("B", None)], None)]
    df = fx.frame(spark, rows, "id long, s array<struct<subject:string,marks:int>>, total int")
    return df.select("id", F.explode(marks.fill_single_missing(F.col("s"), F.col("total"))).alias("s")).select("id", "s.subject", F.col("s.marks").cast("long").alias("marks"))


def request_metrics(spark, sf_dir):
    """Events as if they were requests, errors among them; an analogy, not a request log."""
    rows = _table(spark, sf_dir, "events").select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    out = metrics.request_metrics(rows)
    return out.select("requests_total", "requests_error", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("mean_ok_latency_ms", 6).alias("mean_ok_latency_ms"))


def hourly_requests(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    return metrics.windowed_metrics(rows).select("start", "requests_total", "requests_error", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


def masked_ids(spark, sf_dir):
    return fx.frame(spark, [(1, "000011112222"), (2, "AB-1"), (3, None), (4, "KA00 20000000000")], "id long, v string").select("id", masked(F.col("v")).alias("masked"))


def page(lines: list[str], doc_id: int, pass_no: int = 1) -> tuple:
    """A document whose lines stand one below the other."""
    tokens = [(k, t, [[10.0, 40.0 * k], [10.0 + 8 * len(t), 40.0 * k], [10.0 + 8 * len(t), 40.0 * k + 20], [10.0, 40.0 * k + 20]], 0.9) for k, t in enumerate(lines)]
    return (doc_id, "image/png", 100, 1000, 2000, 30.0, pass_no, tokens)


SHEET = ["KARNATAKA SECONDARY EDUCATION EXAMINATION BOARD", "NAME OF THE CANDIDATE: TEST PERSON", "FATHER'S NAME: OTHER PERSON", "MOTHER'S NAME: THIRD PERSON", "REGISTER NO: AB12345", "FIRST LANGUAGE KANNADA 125 44 110", "SECOND LANGUAGE ENGLISH 100 35 88", "MATHEMATICS 100", "SOCIAL SCIENCE 100 35 80", "GRAND TOTAL 625 369"]


def example_documents(spark) -> DataFrame:
    rows = [page(x, 100 + i) for i, x, *_ in fx.LETTERS[:3]] + [page(x, 200 + i) for i, x, *_ in fx.CARDS[:2]] + [page(x, 300 + i) for i, x, *_ in fx.LICENCES[:2]]
    return spark.createDataFrame([*rows, page(SHEET, 401), page(["a", "b"], 501), page(["a", "b", "c"], 502)], DOCUMENT)


def extract_documents(spark, sf_dir):
    return as_json(extract(example_documents(spark)), mask=False, lines=True)


#: The sheet with two marks missing, and a second recognition of it that finds one of them.
SHEET_OF_TWO = [x.replace("SOCIAL SCIENCE 100 35 80", "SOCIAL SCIENCE 100") for x in SHEET]


def recover_documents(spark, sf_dir):
    first = extract(example_documents(spark).unionByName(spark.createDataFrame([page(SHEET_OF_TWO, 402)], DOCUMENT)))
    again = [x.replace("MATHEMATICS 100", "MATHEMATICS 100 35 91") for x in SHEET_OF_TWO]
    return as_json(recover(first, extract(spark.createDataFrame([page(again, 402, 2)], DOCUMENT))), mask=False, lines=True)


#: Queries over given tables, which are registered; and rules shown on invented rows, which the tests run.
QUERIES = {f.__name__: f for f in (classify_documents, class_counts, lines_min_text, line_marks, decimal_pairs, long_digit_ids, token_mode, repeated_lines, request_metrics, hourly_requests)} | tables.QUERIES
EXAMPLES = {f.__name__: f for f in (reject_reasons, grouped_lines, grouped_lines_array, core_keys, boards, grade_averages, totals, registers, spelt_numbers, repaired_spacing, aadhaar_fields, licence_fields, pan_fields, sheet_subjects, reconciled_marks, college_names, sheet_people, agreed_names, letter_styles, unscaled_boxes, reading_orders, merged_subjects, single_missing, masked_ids, extract_documents, recover_documents)}

_DOC_LINES = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, {fx.literal(w)})" for w in words) + ")"


_CLASS = f"""CASE WHEN {_any(("AADHAAR", "AADHAR", "UNIQUE IDENTIFICATION", "UIDAI"))} THEN 'Aadhaar'
  WHEN contains(t, 'GOVERNMENT OF INDIA') AND {_any(("DOB", "YEAR OF BIRTH", "YOB"))} AND contains(t, 'MALE') THEN 'Aadhaar'
  WHEN {_any(("VID :", "VID:"))} THEN 'Aadhaar' WHEN {_any(("PERMANENT ACCOUNT NUMBER", "INCOME TAX DEPARTMENT"))} THEN 'PAN'
  WHEN {_any(("DRIVING LICENCE", "DL NO", "DRIVING LICENSE"))} OR regexp_matches(t, '\\b[A-Z]{{2}}[-\\s]?[0-9]{{2}}[-\\s]?[0-9]{{4}}[-\\s]?[0-9]{{7}}\\b') THEN 'Driving License'
  WHEN {_any(classify.MARKSHEET_WORDS)} OR regexp_matches(t, 'S\\.?\\s*S\\.?\\s*L\\.?\\s*C') OR (contains(t, 'KARNATAKA') AND {_any(("BOARD", "SECONDARY"))}) THEN 'Marksheet'
  WHEN regexp_matches(t, '\\b[0-9]{{4}}\\s?[0-9]{{4}}\\s?[0-9]{{4}}\\b') THEN 'Aadhaar' ELSE 'Unknown' END"""
_CLASSIFIED = f"SELECT doc_id, {_CLASS} AS document_type FROM (SELECT doc_id, upper(array_to_string(lines, ' ')) AS t FROM (SELECT * FROM {fx.values([(-i, x) for i, x, _ in fx.CLASSES], 'doc_id, lines')} UNION ALL {_DOC_LINES}))"
_GROUPED = f"""
WITH t AS (SELECT * FROM {fx.values(fx.TOKENS, "doc_id, pos, text, x, y, x_end, height, width")}),
a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, pos) <= CASE WHEN height > 0 THEN greatest(4, floor(height * 0.01)) ELSE 15 END THEN 0 ELSE 1 END AS n FROM t),
b AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY y, pos ROWS UNBOUNDED PRECEDING) AS r FROM a),
c AS (SELECT *, CASE WHEN lag(r) OVER w = r AND x - lag(x_end) OVER w <= CASE WHEN width > 0 THEN greatest(50, floor(width * 0.20)) ELSE 1000 END THEN 0 ELSE 1 END AS m, row_number() OVER w AS nth FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY r, x, y, pos)),
d AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING) AS k FROM c)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(k AS BIGINT) AS line_no, upper(string_agg(text, ' ' ORDER BY nth)) AS line FROM d GROUP BY doc_id, k"""
_REQUESTS = "SELECT ts, event_type <> 'error' AS ok, value AS latency_ms FROM events"


def _expected(rows: list[tuple], names: str, keep: list[int], casts: dict[str, str] | None = None) -> str:
    """A fixture's expected values, which were derived by hand from the rules."""
    kinds = {"id": "BIGINT"} | (casts or {})
    columns = ", ".join(f"CAST({n.strip()} AS {kinds.get(n.strip(), 'VARCHAR')}) AS {n.strip()}" for n in names.split(","))
    return f"SELECT {columns} FROM {fx.values([tuple(r[k] for k in keep) for r in rows], names)}"


def _document(i: int, kind: str | None, lines: list[str], reason: str | None = None, **fields) -> tuple[int, str]:
    """A document as JSON, nulls left out, with fields that were derived by hand."""
    have = {"pass_no": 1, "document_type": kind or "Unknown", "reject_reason": reason, "lines": lines} | {k: {n: v for n, v in x.items() if v is not None} for k, x in fields.items()}
    return i, json.dumps({k: v for k, v in have.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)


def _mark(subject: str, value: int, read: bool = True) -> dict:
    return {"subject": subject, "marks": value, "additional": False} | ({"marks_raw": value} if read else {}) | {"adjusted": not read}


def _state_sheet(*subjects: dict) -> dict:
    return {
        "student_name": "TEST PERSON", "father_name": "OTHER PERSON", "mother_name": "THIRD PERSON", "subjects": list(subjects), "total_marks": 369,
        "board": "KARNATAKA STATE SECONDARY EDUCATION EXAMINATION BOARD", "register_number": "AB12345",
    }


_LETTER, _CARD = fx.LETTERS[0], fx.CARDS
_LANGUAGES = (_mark("FIRST LANGUAGE KANNADA", 110), _mark("SECOND LANGUAGE ENGLISH", 88))
_EXTRACTED = [
    _document(101, "Aadhaar", _LETTER[1], aadhaar={"name": _LETTER[2], "date_of_birth": _LETTER[3], "gender": _LETTER[5], "aadhaar_number": _LETTER[6]}),
    *[_document(100 + k, None, x[1], "unknown_document") for k, x in ((2, fx.LETTERS[1]), (3, fx.LETTERS[2]))],
    *[_document(200 + k, "PAN", x[1], pan={"name": x[4], "father_name": x[5], "pan_number": x[2], "date_of_birth": x[3]}) for k, x in ((1, _CARD[0]), (2, _CARD[1]))],
    *[_document(300 + k, "Driving License", x[1], driving_license={"dl_number": x[2], "name": x[4], "dob": x[3]}) for k, x in ((1, fx.LICENCES[0]), (2, fx.LICENCES[1]))],
    _document(401, "Marksheet", SHEET, marksheet=_state_sheet(*_LANGUAGES, _mark("MATHEMATICS", 91, read=False), _mark("SOCIAL SCIENCE", 80))),
    _document(501, None, ["a", "b"], "too_little_text"),
    _document(502, None, ["a", "b", "c"], "unknown_document"),
]
_RECOVERED = [*_EXTRACTED, _document(402, "Marksheet", SHEET_OF_TWO, marksheet=_state_sheet(*_LANGUAGES, _mark("MATHEMATICS", 91), _mark("SOCIAL SCIENCE", 80, read=False)))]
_MARKS_READ = dict(zip(("ALGEBRA", "PRACTICE", "SYSTEMS"), (80, 30, 40), strict=True))


def _mended() -> str:
    """The spacing rules in SQL."""
    t = "text"
    for wrong, right in tx.SPACING.items():
        t = f"replace({t}, {fx.literal(wrong)}, {fx.literal(right)})"
    for words in ("OF|AND|FOR|THE", "INSTITUTE|COLLEGE|TECHNOLOGY|UNIVERSITY"):
        t = f"regexp_replace({t}, '([A-Z])({words})\\b', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


_NAMES = ", ".join(f"({fx.literal(k)}, {fx.literal(v)})" for k, v in tx.FULL_NAMES.items())
_PICK = "CASE WHEN len(list_filter(nums, lambda v: v <> 0)) = 0 OR (len(nums) = 1 AND nums[1] IN (100, 125, 150)) OR nums[-1] > 200 THEN NULL ELSE nums[-1] END"

_SQL = {
    "classify_documents": _CLASSIFIED,
    "class_counts": f"SELECT document_type, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY document_type",
    "reject_reasons": f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN coalesce(mime, '') <> '' AND NOT starts_with(mime, 'image/') THEN 'unsupported_type' WHEN length = 0 THEN 'empty_file' WHEN length > 20971520 THEN 'too_large'
  WHEN NOT decoded THEN 'not_an_image' WHEN center_std < 12 THEN 'blank_image' WHEN n_texts < 3 THEN 'too_little_text' WHEN kind = 'Unknown' THEN 'unknown_document' END AS reason FROM {fx.values([r[:7] for r in fx.UPLOADS], "id, mime, length, decoded, center_std, n_texts, kind")}""",
    "lines_min_text": f"SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines FROM ({_DOC_LINES}) WHERE len(lines) >= 3",
    "grouped_lines": _GROUPED,
    "grouped_lines_array": _GROUPED,
    "line_marks": f"""SELECT doc_id, line_no, CAST(len(nums) AS BIGINT) AS n, CAST(nums[-1] AS BIGINT) AS last, CAST({_PICK} AS BIGINT) AS mark FROM
  (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, list_transform(regexp_extract_all(lines[i], '\\b[0-9]{{1,3}}\\b'), lambda v: CAST(v AS INTEGER)) AS nums FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM ({_DOC_LINES}))) WHERE len(nums) > 0""",
    "decimal_pairs": f"SELECT doc_id, d[-2] AS next_to_last, d[-1] AS last FROM (SELECT doc_id, regexp_extract_all(array_to_string(lines, ' '), '\\b[0-9]{{1,2}}\\.[0-9]{{1,3}}\\b') AS d FROM ({_DOC_LINES})) WHERE len(d) >= 2",
    "long_digit_ids": f"""SELECT doc_id, list_filter(list_transform(lines, lambda x: nullif(regexp_extract(replace(x, ' ', ''), '\\b[0-9]{{12}}\\b'), '')), lambda v: v IS NOT NULL)[1] AS twelve,
  CAST(len(regexp_extract_all(replace(array_to_string(lines, chr(10)), ' ', ''), '[0-9]{{16}}')) AS BIGINT) AS sixteens FROM (SELECT * FROM {fx.values([(-r[0], r[1]) for r in fx.LETTERS], "doc_id, lines")} UNION ALL {_DOC_LINES})""",
    "token_mode": """SELECT doc_id, word, n FROM (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS k FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)) GROUP BY doc_id, word) WHERE k = 1 AND n >= 2""",
    "repeated_lines": f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, CAST(unnest(range(len(lines))) AS BIGINT) AS pos FROM ({_DOC_LINES})), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM l)
  SELECT a.doc_id, a.pos, a.line FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 AND a.line = b.line AND a.nth = b.nth""",
    "core_keys": f"""SELECT name, coalesce((SELECT c FROM (VALUES {", ".join(f"({fx.literal(c)})" for c in sheets.CORE)}) k(c) WHERE contains(upper(name), c) ORDER BY length(c) DESC LIMIT 1), upper(name)) AS core FROM {fx.values([(n,) for n in SUBJECT_NAMES], "name")}""",
    "boards": f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN {_any(("SCHOOL EXAMINATION AND ASSESSMENT", "EXAMINATION AND ASSESSMENT BOARD", "KSEAB"))} THEN 'KARNATAKA PU BOARD (NEW)'
  WHEN {_any(("PRE-UNIVERSITY", "PRE UNIVERSITY", "PUCOLLEGE", "PU COLLEGE"))} OR (contains(t, 'PUC') AND contains(t, 'EXAMINATION')) THEN 'KARNATAKA PU BOARD' WHEN {_any(("CBSE", "CENTRAL BOARD"))} THEN 'CBSE'
  WHEN {_any(("ICSE", "INDIAN CERTIFICATE", "COUNCIL FOR THE INDIAN SCHOOL"))} THEN 'ICSE'
  WHEN {_any(("SECONDARY EDUCATION", "SSLC"))} OR regexp_matches(t, 'S\\.?\\s*S\\.?\\s*L\\.?\\s*C') OR (contains(t, 'KARNATAKA') AND {_any(("BOARD", "SECONDARY"))}) OR (contains(t, 'GOVERNMENT OF KARNATAKA') AND contains(t, 'KANNADA')) THEN 'KARNATAKA STATE BOARD'
  WHEN {_any(("UNIVERSITY", "VTU", "VISVESVARAYA"))} THEN 'VTU' END AS board FROM (SELECT id, upper(array_to_string(lines, ' ')) AS t FROM {fx.values([r[:2] for r in fx.BOARDS], "id, lines")})""",
    "grade_averages": _expected(fx.AVERAGES, "id, sgpa, cgpa", [0, 2, 3], {"sgpa": "DOUBLE", "cgpa": "DOUBLE"}),
    "totals": _expected(fx.TOTALS, "id, total", [0, 2], {"total": "BIGINT"}),
    "registers": _expected(fx.REGISTERS, "id, number, kind, semester", [0, 2, 3, 4]),
    "spelt_numbers": _expected(fx.SPELT, "id, value", [0, 2], {"value": "BIGINT"}),
    "repaired_spacing": f"SELECT CAST(id AS BIGINT) AS id, {_mended()} AS text, coalesce((SELECT n FROM (VALUES {_NAMES}) k(s, n) WHERE s = upper(trim(board))), upper(trim(board))) AS full_name FROM {fx.values(fx.SPACINGS, 'id, text, board')}",
    "sheet_subjects": _expected(fx.SHEET_MARKS, "id, subject, marks, certainty", [0, 1, 2, 3], {"marks": "BIGINT"}),
    "reconciled_marks": _expected([(i, s, m, r, m != r, t) for i, _, after, t in fx.RECONCILED for (s, r), m in zip(_MARKS_READ.items(), after, strict=True)], "id, subject, marks, marks_raw, adjusted, total", [0, 1, 2, 3, 4, 5], {"marks": "BIGINT", "marks_raw": "BIGINT", "adjusted": "BOOLEAN", "total": "BIGINT"}),
    "college_names": _expected(fx.COLLEGES, "id, college", [0, 3]),
    "sheet_people": _expected(fx.PEOPLE, "id, student_name, father_name, mother_name", [0, 2, 3, 4]),
    "agreed_names": _expected(fx.AGREED, "id, student_name, father_name, mother_name", [0, 5, 6, 7]),
    "letter_styles": f"SELECT CAST(id AS BIGINT) AS id, height > CAST(1.15 AS DOUBLE) * width OR (len(list_filter(lines, lambda x: upper(trim(x)) IN ('TO', 'TO,'))) > 0 AND contains(upper(array_to_string(lines, ' ')), 'ENROLMENT')) AS new_style FROM {fx.values([r[:4] for r in fx.LETTER_STYLES], 'id, lines, height, width')}",
    "unscaled_boxes": _expected([(i, k, x, y, 0.5) for i, _, _, box in fx.SCALED for k, (x, y) in enumerate(box)], "id, k, x, y, conf", [0, 1, 2, 3, 4], {"k": "BIGINT", "x": "DOUBLE", "y": "DOUBLE", "conf": "DOUBLE"}),
    "reading_orders": _expected([(i, k, t) for i, _, texts in fx.TURNED for k, t in enumerate(texts)], "id, place, text", [0, 1, 2], {"place": "BIGINT"}),
    "extract_documents": _expected(_EXTRACTED, "doc_id, json", [0, 1], {"doc_id": "BIGINT"}),
    "recover_documents": _expected(_RECOVERED, "doc_id, json", [0, 1], {"doc_id": "BIGINT"}),
    "aadhaar_fields": _expected(fx.LETTERS, "id, name, date_of_birth, year_of_birth, gender, aadhaar_number", [0, 2, 3, 4, 5, 6]),
    "licence_fields": _expected(fx.LICENCES, "id, dl_number, dob, name", [0, 2, 3, 4]),
    "pan_fields": _expected(fx.CARDS, "id, pan_number, date_of_birth, name, father_name", [0, 2, 3, 4, 5]),
    "merged_subjects": _expected([(i, k, n, m) for i, _, _, want in fx.PASSES for k, (n, m) in enumerate(want)], "id, pos, subject, marks", [0, 1, 2, 3], {"pos": "BIGINT", "marks": "BIGINT"}),
    "single_missing": _expected([(1, "A", 50), (1, "B", 70), (2, "A", 50), (2, "B", None), (2, "C", None), (3, "A", 50), (3, "B", None), (4, "A", 50), (4, "B", None)], "id, subject, marks", [0, 1, 2], {"marks": "BIGINT"}),
    "request_metrics": f"SELECT count(*) AS requests_total, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS requests_error, round(sum(latency_ms) FILTER (WHERE ok) / count(*), 6) AS avg_latency_ms, round(avg(latency_ms) FILTER (WHERE ok), 6) AS mean_ok_latency_ms FROM ({_REQUESTS})",
    "hourly_requests": f"SELECT date_trunc('hour', ts) AS start, count(*) AS requests_total, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS requests_error, round(coalesce(sum(latency_ms) FILTER (WHERE ok) / count(*), 0), 6) AS avg_latency_ms FROM ({_REQUESTS}) GROUP BY 1",
    "masked_ids": _expected([(1, "XXXXXXXX2222"), (2, "AB-1"), (3, None), (4, "XXXX XXXXXXX0000")], "id, masked", [0, 1]),
}

ORACLE_SQL = {name: _SQL[name] for name in QUERIES if name in _SQL} | tables.ORACLE_SQL
EXAMPLE_SQL = {name: _SQL[name] for name in EXAMPLES}
