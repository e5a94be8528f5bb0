"""Column builders: exact rates and guarded statistics (numeric), tiers, bins and
scores (tiers), date parsing and calendar helpers (dates).
"""
