"""callrank: campaign-conversion analytics and propensity scoring on Spark.

Every operator takes a DataFrame and returns a DataFrame (or a fitted
``pyspark.ml`` model).  Row data never passes through the driver; only
bounded things (models, metrics, category domains, quantile cut points)
reach it.
"""

from callrank.spec import FeatureSpec

__all__ = ["FeatureSpec"]
__version__ = "0.1.0"
