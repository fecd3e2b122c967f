"""skuflow: a PySpark-native engine for nested part-quotation records.

Bids (one vehicle + a list of quoted parts) are flattened, validated and
profiled; part descriptions are normalised; vehicle series are canonicalised;
TF-IDF features and spark.ml classifiers predict the part number (SKU) from a
description; predictions are ranked, evaluated and fed back for retraining.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` so Catalyst can prune, push down and codegen it.
"""

__version__ = "0.1.0"
