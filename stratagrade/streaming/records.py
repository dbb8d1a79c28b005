"""The row pipeline over streams: binding, cleaning, filtering and normalizing keep no
state.  First-wins deduplication does: on a stream the first row to arrive within the
watermark wins, which is not the first row of the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..schemas import IDENTITY


def normalized_stream(stream: DataFrame, mapping: dict[str, str]) -> DataFrame:
    rows = records.clean_columns(records.convert_schema(stream, records.check_mapping(mapping)))
    return records.normalize_columns(rows.where(F.col("field_name") != ""))


def first_arrivals(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(IDENTITY))
