"""ebbtide — customer-retention analytics as Spark DataFrame jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` so Catalyst can prune, push down and codegen it.
"""

from ebbtide.config import RetentionConfig, DEFAULT_CONFIG

__all__ = ["RetentionConfig", "DEFAULT_CONFIG"]
