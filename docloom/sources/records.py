"""Reading recognised documents and uploads, and writing results."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT

#: Identifiers within texts, as java.util.regex has it; sources/uploads.py masks the same.
IDENTIFIERS = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[A-Z]{5}[0-9]{4}[A-Z]|[A-Z]{2}[ -]?[0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{7})(?![0-9A-Za-z])"


class Recogniser(Protocol):
    """What an engine for images has to offer: per image its size, a flatness measure, and tokens.

    It is called on Arrow batches of (path, content) and returns rows of schema.DOCUMENT without doc_id.
    Decoding, rotation, recognition and cropping of pictures lie outside this package.
    """

    def __call__(self, batches): ...


def read_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Recognised documents from Parquet, JSON or ORC, with the declared schema and no inference."""
    return spark.read.schema(DOCUMENT).format(kind).load(path)


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploaded files: path, length, content and sha256 of the content, which tells repeated uploads apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def recognise(uploads: DataFrame, engine: Recogniser) -> DataFrame:
    """Each different content once through an engine; repeated uploads share its result."""
    once = uploads.dropDuplicates(["sha256"]).select("sha256", "path", "content")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT.fields if f.name != "doc_id")
    done = once.mapInPandas(engine, f"sha256 string, {fields}")
    return uploads.select("path", "sha256").join(done, "sha256")


def masked(x: Column, shown: int = 4) -> Column:
    """All letters and digits but the last few of an identifier hidden."""
    keep = F.greatest(F.length(x) - shown, F.lit(0))
    return F.concat(F.regexp_replace(F.substring(x, F.lit(1), keep), "[A-Za-z0-9]", "X"), F.substring(x, keep + 1, F.lit(shown)))


def masked_texts(x: Column) -> Column:
    """Texts with every identifier in them masked: twelve digits in fours, tax and licence numbers."""
    hidden = lambda t: F.array_join(F.transform(F.split(F.regexp_replace(t, f"({IDENTIFIERS})", "\u0001$1\u0001"), "\u0001", -1), lambda p, k: F.when(k % 2 == 1, masked(p)).otherwise(p)), "")
    return F.transform(x, hidden)


def _without(lines: Column, identifier: Column) -> Column:
    """Lines with an identifier masked as it was read, whatever its pattern."""
    return F.transform(lines, lambda t: F.replace(t, identifier, masked(identifier)))


#: Where results hold identifiers.
IDENTIFYING = {"aadhaar": ("aadhaar_number",), "pan": ("pan_number",), "driving_license": ("dl_number",), "marksheet": ("usn", "register_number")}


def mask_identifiers(results: DataFrame) -> DataFrame:
    """Results as sinks have to have them: identifying fields masked, and identifiers within the lines as well."""
    out, lines = results, masked_texts(F.col("lines"))
    for struct, fields in IDENTIFYING.items():
        for field in fields:
            lines = _without(lines, F.coalesce(F.col(f"{struct}.{field}"), F.lit("")))
    out = out.withColumn("lines", lines)
    for struct, fields in IDENTIFYING.items():
        for field in fields:
            out = out.withColumn(struct, F.col(struct).withField(field, masked(F.col(f"{struct}.{field}"))))
    return out


def for_sink(results: DataFrame, mask: bool = True, lines: bool = False) -> DataFrame:
    """What leaves the package: the fields that were read, identifiers masked, the lines they were read from left behind. Every sink goes through here."""
    out = mask_identifiers(results) if mask else results
    return out if lines else out.drop("lines")


def as_json(results: DataFrame, mask: bool = True, lines: bool = False) -> DataFrame:
    """One JSON text per document, null fields left out; identifiers and lines as in for_sink."""
    out = for_sink(results, mask, lines)
    return out.select("doc_id", F.to_json(F.struct(*[c for c in out.columns if c != "doc_id"])).alias("json"))


def write_results(results: DataFrame, path: str, kind: str = "parquet", mask: bool = True, lines: bool = False) -> None:
    """Results partitioned by document type; identifiers and lines as in for_sink."""
    for_sink(results, mask, lines).write.partitionBy("document_type").format(kind).mode("overwrite").save(path)
