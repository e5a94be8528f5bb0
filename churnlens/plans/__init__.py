"""Plans around the operators: the table bundle (tables), the query registry
(catalog) and the DuckDB oracle (oracle, oracle_check).
"""
