"""Schemas of everything the engine reads. Readers always pass one of these, nothing is inferred."""

from pyspark.sql import types as T

CONNECTION = T.StructType([
    T.StructField("ssid", T.StringType()),
    T.StructField("rssi", T.DoubleType()),
])

READING = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("lastUpdatedTime", T.LongType()),
    T.StructField("connection", CONNECTION),
])

# A chunk file is either {"response": [reading, ...]} or a bare array of readings, so the
# reader sees one document with "response" set, or one row per reading with the other fields set.
CHUNK_FILE = T.StructType([T.StructField("response", T.ArrayType(READING)), *READING.fields])

EVENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("rssi", T.FloatType()),
    T.StructField("ssid", T.StringType()),
])

RUN_LOG = T.StructType([
    T.StructField("dbType", T.StringType()),
    T.StructField("run", T.StringType()),
    T.StructField("ingestion", T.ArrayType(T.StructType([
        T.StructField("durationMs", T.LongType()),
        T.StructField("nRecords", T.LongType()),
    ]))),
    T.StructField("queries", T.ArrayType(T.StructType([
        T.StructField("queryId", T.IntegerType()),
        T.StructField("durationMs", T.LongType()),
        T.StructField("description", T.StringType()),
    ]))),
])
