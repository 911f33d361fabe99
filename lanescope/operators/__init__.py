"""DataFrame -> DataFrame operators: cleaning, segment KPIs, benchmarks, exact quantiles,
data quality and top-k."""
