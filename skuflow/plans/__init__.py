"""Named query plans: importing this package registers every query and oracle.

spark.ml training queries are registered last, so relational and streaming
queries come first in ``queries()`` order.
"""

from skuflow.plans import bids, feedback, hierarchy, io, predict, profile, streaming, text  # noqa: F401
from skuflow.plans import ml  # noqa: F401  (model training/scoring queries last)
from skuflow.plans.registry import ORACLES, QUERIES  # noqa: F401
