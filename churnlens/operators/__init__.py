"""Analytics operators: each takes a ChurnTables bundle and returns a DataFrame.

kpis, segments, timeseries, risk, statistics, report (SQL report and analysis
frames); cleaning and constraints (data quality); extras (figures stated in prose).
"""
