"""churnlens: subscription retention analytics as Spark DataFrame operators.

Typical use::

    from churnlens import ChurnTables, build_session
    from churnlens.operators import kpis, segments

    spark = build_session()
    tables = ChurnTables.derive(spark, "/path/to/tables").materialize()
    kpis.overall_churn(tables).show()
    segments.churn_by_region_ranked(tables).show()
"""

from churnlens.plans.tables import ChurnTables
from churnlens.session import build_session, checkpoint_root

__all__ = ["ChurnTables", "build_session", "checkpoint_root"]
