"""geoweft: Spark-native extraction, geocoding, linking and tracing of open map data."""

__version__ = "0.1.0"
