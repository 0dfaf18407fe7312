"""Daily rows to report periods as a stream: the batch mapping of days to periods with a watermark. A Spark-native extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.panel import report_period


def period_sums(stream: DataFrame, ts: str, key: str, value: str, late: str = "240 days") -> DataFrame:
    """key, period, total, rows of a stream (or table) of events, one row a key and period.

    The state of a key and period is known by the period's end, which is its event time: it goes when the watermark, `late` behind the latest
    period, has passed it. A period's last events come some seven months after its end, so `late` should be no less.
    """
    s = stream.withColumn("period", report_period(F.to_date(ts)).cast("timestamp")).withWatermark("period", late)
    return s.groupBy(F.col(key), F.col("period")).agg(F.sum(value).alias("total"), F.count(value).alias("rows")).withColumn("period", F.to_date("period"))
