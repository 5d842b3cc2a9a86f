"""tidewatch: anomaly analytics for event streams and tables on Apache Spark.

Count-based sliding-window statistics per feature, z-score / Tukey-fence
detection, a distributed isolation forest, and severity-graded,
deduplicated, rate-limited alerts -- all as DataFrame operations that run
the same way in batch jobs and in Structured Streaming.
"""

from tidewatch.params import AlertParams, DetectorParams, ForestParams

__all__ = ["AlertParams", "DetectorParams", "ForestParams"]
__version__ = "0.1.0"
