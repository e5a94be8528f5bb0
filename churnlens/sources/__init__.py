"""Sources and sinks: the derived customer record (tpch), the dirty fixture,
the relational load (warehouse) and CSV / text files (files).
"""
