"""Date and time features (DAT*).

Timestamps without a zone (``timestamp_ntz``) stay NTZ: ``date_trunc``
returns a zoned timestamp, so results are cast back (the session zone is UTC).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c

# fixed values: formats tried when no format is given (strftime spelling, in order)
AUTO_FORMATS = ["%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y",
                "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S"]

# fixed values: date-like text patterns used to sniff a column
DATE_PATTERNS = [r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$", r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$",
                 r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"^\d{4}-\d{2}-\d{2}$",
                 r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"]

_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy",
             "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%p": "a", "%I": "hh", "%j": "DDD", "%%": "%"}


def strftime_to_spark(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _STRFTIME:
            out.append(_STRFTIME[tok])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


def parse_datetime_expr(col: Column, fmt: str | None = None) -> Column:
    """Text -> timestamp_ntz; ``fmt`` in strftime spelling; bad values -> null."""
    s = col.cast("string")
    if fmt:
        return F.try_to_timestamp(s, F.lit(strftime_to_spark(fmt))).cast("timestamp_ntz")
    tries = [F.try_to_timestamp(s, F.lit(strftime_to_spark(f))) for f in AUTO_FORMATS]
    tries.append(F.try_to_timestamp(s))
    return F.coalesce(*tries).cast("timestamp_ntz")


def parse_datetime(df: DataFrame, col: str, fmt: str | None = None, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, parse_datetime_expr(c(col), fmt))


def _ts(col: str) -> Column:
    return c(col)


FEATURES = ["year", "month", "day", "hour", "minute", "second", "dayofweek", "quarter", "weekofyear",
            "is_weekend", "is_month_end", "is_month_start"]


def date_feature_expr(ts: Column, feature: str) -> Column:
    return {
        "year": lambda: F.year(ts), "month": lambda: F.month(ts), "day": lambda: F.dayofmonth(ts),
        "hour": lambda: F.hour(ts), "minute": lambda: F.minute(ts), "second": lambda: F.second(ts),
        "dayofweek": lambda: F.weekday(ts), "quarter": lambda: F.quarter(ts),
        "weekofyear": lambda: F.weekofyear(ts), "is_weekend": lambda: F.weekday(ts) >= 5,
        "is_month_end": lambda: F.to_date(ts) == F.last_day(ts), "is_month_start": lambda: F.dayofmonth(ts) == 1,
        "day_name": lambda: F.date_format(ts, "EEEE"), "month_name": lambda: F.date_format(ts, "MMMM"),
        "quarter_label": lambda: F.concat(F.lit("Q"), F.quarter(ts).cast("string")),
        "period_year": lambda: F.year(ts).cast("string"),
    }[feature]()


def date_features(df: DataFrame, col: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """``{col}_{feature}`` columns; day of week has Monday = 0."""
    return df.withColumns({f"{col}_{f}": date_feature_expr(_ts(col), f) for f in features})


_UNIT_SECONDS = {"days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}


def time_diff(df: DataFrame, a: str, b: str, unit: str = "days", out: str | None = None) -> DataFrame:
    """(a - b) in fractional days / hours / minutes / seconds."""
    micros = F.timestamp_diff("MICROSECOND", _ts(b), _ts(a))
    return df.withColumn(out or f"{a}_minus_{b}_{unit}", micros / (1e6 * _UNIT_SECONDS[unit]))


def period_key(df: DataFrame, col: str, period: str, out: str | None = None) -> DataFrame:
    """day_name | month_name | quarter_label | period_year."""
    return df.withColumn(out or f"{col}_{period}", date_feature_expr(_ts(col), period))


def trunc_ntz(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz")


# -- DAT9 --------------------------------------------------------------------------------
def infer_period(df: DataFrame, ts: str, order_by: str | None = None) -> DataFrame:
    """Most common gap between consecutive timestamps -> frequency and seasonal period.

    D 365, W 52, M 12, Q 4, Y 1; otherwise the longest of 365, 52, 12, 4 that the series covers, else 2.
    Gaps come from the halo window of ``plans.ordered`` (no global window).
    """
    from tessera.plans.ordered import drop_halo, with_halo

    order_by = order_by or ts
    d, w = with_halo(df.select(c(ts).alias("__t"), *([c(order_by).alias("__o")] if order_by != ts else [])),
                     ["__o"] if order_by != ts else ["__t"], None, 2)
    d = d.withColumn("__gap", F.timestamp_diff("SECOND", F.lag("__t").over(w), F.col("__t")))
    gaps = drop_halo(d).where(F.col("__gap").isNotNull())
    counts = gaps.groupBy("__gap").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("__gap").alias("g"))).alias("m"))
    total = df.agg(F.count(c(ts))).scalar()
    g = mode.select("m.g").scalar()
    day = 86400
    freq = (F.when(g == day, "D").when(g == 7 * day, "W").when(g.between(28 * day, 31 * day), "M")
            .when(g.between(89 * day, 92 * day), "Q").when(g.between(365 * day, 366 * day), "Y"))
    period = (F.when(freq == "D", 365).when(freq == "W", 52).when(freq == "M", 12).when(freq == "Q", 4)
              .when(freq == "Y", 1)
              .when(total >= 365, 365).when(total >= 52, 52).when(total >= 12, 12).when(total >= 4, 4).otherwise(2))
    return df.sparkSession.range(1).select(g.alias("gap_seconds"), freq.alias("frequency"),
                                           period.cast("int").alias("seasonal_period"))


# -- DAT10 --------------------------------------------------------------------------------
_FREQ_UNIT = {"D": ("DAY", "1 day"), "W": ("WEEK", "7 days"), "MS": ("MONTH", "1 month"),
              "QS": ("QUARTER", "3 months"), "YS": ("YEAR", "1 year")}


def period_start(ts: Column, freq: str) -> Column:
    """Start of the period; weeks are labelled by their Sunday end like pandas 'W'."""
    if freq == "W":
        # pandas 'W' = weeks ending Sunday, labelled by that Sunday
        return F.date_add(F.to_date(trunc_ntz("WEEK", ts)), 6).cast("timestamp_ntz")
    return trunc_ntz(_FREQ_UNIT[freq][0], ts)


def resample(df: DataFrame, ts: str, value: str, freq: str = "D", agg: str = "mean") -> DataFrame:
    """Aggregate per period with a full calendar spine: empty periods appear with null.

    The spine is generated from min/max with ``sequence`` - its size is the
    number of periods in the range, not the number of rows.
    """
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[agg]
    key = period_start(c(ts), freq)
    g = df.groupBy(key.alias("period")).agg(fn(c(value).cast("double")).alias(value))
    bounds = g.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    step = F.expr(f"INTERVAL {_FREQ_UNIT[freq][1]}") if freq != "W" else F.expr("INTERVAL 7 days")
    spine = bounds.select(F.explode(F.sequence(F.col("a"), F.col("b"), step)).alias("period"))
    return spine.join(g, "period", "left")


def detect_datetime(df: DataFrame, col: str, threshold: float = 0.7, probe: int = 100) -> DataFrame:
    """SRC8: share of the first ``probe`` non-null values matching each date pattern; likely if any > threshold."""
    sample = df.where(c(col).isNotNull()).select(c(col).cast("string").alias("s")).limit(probe)
    shares = sample.agg(*[F.avg(F.col("s").rlike(p).cast("double")).alias(f"p{i}") for i, p in enumerate(DATE_PATTERNS)])
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(DATE_PATTERNS))])
    return shares.select(F.lit(col).alias("column_name"), best.alias("best_share"), (best > threshold).alias("is_datetime"))
