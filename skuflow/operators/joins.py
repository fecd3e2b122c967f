"""Lookup joins without a broadcast hint.

AQE measures the materialised size of the lookup side at run time and switches to a broadcast
hash join only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the join stays
a sort-merge join with skew splitting. Sides bounded by construction (a top-k class list, a capped
vocabulary) are hinted with ``F.broadcast`` where they are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``big`` to a lookup table; the lookup is broadcast only if AQE finds it small."""
    return big.join(small, on=on, how=how)
