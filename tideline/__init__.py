"""Set-based Spark jobs for operational event data.

Three families share one style (DataFrame in, DataFrame out, lazy until a
sink or a one-row gate): reconciling revisioned audit deliveries, forecasting
daily demand for many series, and estimating time to resolution.
"""
