"""Event logs, as streams or as batches."""

from pyspark.sql import DataFrame, SparkSession

from photocat.schema import INGEST_EVENT_SCHEMA, LABEL_EVENT_SCHEMA


def event_source(
    spark: SparkSession, path: str, schema, stream: bool = True, fmt: str = "parquet", **options
) -> DataFrame:
    """Reads event files below ``path`` as a stream, or as its batch twin."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).options(**options).load(path)


def ingest_event_source(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Ingest outcomes and batch starts (``kind = 'Started'``) in one log."""
    return event_source(spark, path, INGEST_EVENT_SCHEMA, **kwargs)


def label_event_source(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    return event_source(spark, path, LABEL_EVENT_SCHEMA, **kwargs)
