"""Document analytics on Spark: cleaning, segmentation, search, extraction and alignment of report-style texts."""

__version__ = "0.1.0"
