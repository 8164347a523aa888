"""Types of recognised documents: tokens with boxes in, typed fields out."""

from pyspark.sql import types as T

TOKEN = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("conf", T.DoubleType())])
TOKENS = T.ArrayType(TOKEN)
#: One recognised document; pass_no 1 is the first recognition, 2 a repeated one.
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("mime", T.StringType()), T.StructField("length", T.LongType()), T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()), T.StructField("center_std", T.DoubleType()), T.StructField("pass_no", T.IntegerType()), T.StructField("tokens", TOKENS),
    ]
)
#: marks_raw is the mark as it was read, null if the sheet gave none; adjusted tells that marks was moved or derived.
SUBJECTS = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("marks", T.IntegerType()), T.StructField("certainty", T.StringType()), T.StructField("additional", T.BooleanType()), T.StructField("marks_raw", T.IntegerType()), T.StructField("adjusted", T.BooleanType())]))
REQUEST = "ts timestamp_ntz, ok boolean, latency_ms double"
