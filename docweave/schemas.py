"""Table schemas."""

from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("short_description", T.StringType()),
        T.StructField("raw_html", T.StringType()),
        T.StructField("crawl_depth", T.IntegerType()),
        T.StructField("crawl_ts", T.TimestampType()),
        T.StructField("content_length", T.IntegerType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("true_start", T.IntegerType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("document_title", T.StringType()),
        T.StructField("document_url", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

FETCH_LOG = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("response_time", T.DoubleType()),
        T.StructField("content_length", T.IntegerType()),
    ]
)

PAYLOAD = T.StructType(
    [
        T.StructField("operation", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error_message", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("payload", PAYLOAD),
    ]
)
