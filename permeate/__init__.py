"""permeate: a PySpark-native analytics engine for life-science records and training-data pipelines."""

__version__ = "0.1.0"
