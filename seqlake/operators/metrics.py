"""Request metrics from a request log ``ts, method, success, latency_us``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in microseconds (fixed values); the last bucket is open.
BOUNDS = (100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000, 250000, 500000, 1000000, 2500000, 5000000, 10000000)
#: Names of the methods as metrics show them (fixed values).
METHODS = ("write", "get", "multiget", "scan", "compare_and_set", "update", "delete", "flush", "create_snapshot", "release_snapshot")
WINDOW_SECONDS = 60


def counters(requests: DataFrame) -> DataFrame:
    """``method, total, success, error`` by method."""
    good = F.count_if(F.col("success"))
    return requests.groupBy("method").agg(F.count("*").alias("total"), good.alias("success"), (F.count("*") - good).alias("error"))


def error_rate(requests: DataFrame) -> DataFrame:
    errors = F.count_if(~F.col("success"))
    return requests.agg(F.count("*").alias("total"), errors.alias("errors"), F.when(F.count("*") == 0, 0.0).otherwise(errors / F.count("*")).alias("error_rate"))


def histogram(requests: DataFrame, bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """``bound_us, cumulative``: requests up to each bound; a null bound is the open bucket.

    One pass with a sum per bound, whatever the number of requests.
    """
    sums = [F.count_if(F.col("latency_us") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = requests.agg(*sums, F.count("*").alias("total"))
    cells = [F.struct(F.lit(b).cast("long").alias("bound_us"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("long").alias("bound_us"), F.col("total").alias("cumulative")))
    return one.select(F.inline(F.array(*cells)))


def quantiles(requests: DataFrame, wanted: tuple[float, ...] = (0.95, 0.99), bounds: tuple[int, ...] = BOUNDS) -> DataFrame:
    """``q, seconds``: the first bound that at least ceil(n * q) requests are within, else the last."""
    cells = histogram(requests, bounds)
    one = cells.agg(F.max("cumulative").alias("n"), F.collect_list(F.struct("bound_us", "cumulative")).alias("cells"))
    rows = one.select("n", "cells", F.explode(F.array(*[F.lit(q) for q in wanted])).alias("q"))

    def within(target: Column) -> Column:
        return F.array_min(F.transform(F.filter("cells", lambda c: c["bound_us"].isNotNull() & (c["cumulative"] >= target)), lambda c: c["bound_us"]))

    bound = F.coalesce(within(F.ceil(F.col("n") * F.col("q"))), F.lit(bounds[-1]))
    return rows.select("q", F.when(F.col("n") == 0, 0.0).otherwise(bound / 1_000_000).alias("seconds"))


def average_and_largest(requests: DataFrame) -> DataFrame:
    return requests.agg(F.coalesce(F.avg("latency_us"), F.lit(0.0)).alias("avg_us"), F.coalesce(F.max("latency_us"), F.lit(0)).alias("max_us"))


def rolling_rate(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``second, requests, qps``: requests of each second and the mean rate of the last minute.

    Requests are summed by second first. The running sum goes hour by hour with the minute
    before each hour added, so that no task needs all seconds.
    """
    by_second = requests.groupBy(F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")).agg(F.count("*").alias("requests"))
    hour = F.floor(F.col("second") / 3600)
    late = F.floor((F.col("second") + seconds - 1) / 3600)
    copies = by_second.select("second", "requests", F.explode(F.array_distinct(F.array(hour, late))).alias("hour"))
    window = Window.partitionBy("hour").orderBy("second").rangeBetween(-(seconds - 1), 0)
    summed = copies.withColumn("qps", F.sum("requests").over(window) / float(seconds))
    return summed.where(hour == F.col("hour")).select("second", "requests", "qps")


def sample_percentiles(requests: DataFrame, wanted: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact nearest-rank percentiles by method: the value at place ceil(n * q)."""
    found = [F.expr(f"percentile_disc({q}) within group (order by latency_us)").cast("long").alias(f"p{round(q * 100)}") for q in wanted]
    return requests.groupBy("method").agg(*found)


def render(requests: DataFrame, prefix: str = "store") -> str:
    """The metrics as text in the exposition format of Prometheus."""
    by_method = {r["method"]: r for r in counters(requests).collect()}
    total = error_rate(requests).first()
    times = average_and_largest(requests).first()
    lines = [f"# TYPE {prefix}_rpc_requests_total counter", f"{prefix}_rpc_requests_total {total['total']}"]
    lines += [f"{prefix}_rpc_requests_success_total {total['total'] - total['errors']}", f"{prefix}_rpc_requests_error_total {total['errors']}", f"{prefix}_rpc_error_rate {total['error_rate']:.6f}"]
    for method in dict.fromkeys([*METHODS, *sorted(by_method)]):
        row = by_method.get(method)
        lines.append(f'{prefix}_rpc_method_requests_total{{method="{method}"}} {row["total"] if row else 0}')
        lines.append(f'{prefix}_rpc_method_errors_total{{method="{method}"}} {row["error"] if row else 0}')
    for cell in histogram(requests).collect():
        le = "+Inf" if cell["bound_us"] is None else f"{cell['bound_us'] / 1e6:.6f}"
        lines.append(f'{prefix}_rpc_latency_seconds_bucket{{le="{le}"}} {cell["cumulative"]}')
    for row in quantiles(requests).collect():
        lines.append(f"{prefix}_rpc_latency_p{round(row['q'] * 100)}_seconds {row['seconds']:.6f}")
    lines += [f"{prefix}_rpc_latency_avg_seconds {times['avg_us'] / 1e6:.6f}", f"{prefix}_rpc_latency_max_seconds {times['max_us'] / 1e6:.6f}"]
    return "\n".join(lines) + "\n"
