"""mosaiq: a Spark-first analytics engine for catalogues, point sets, raster tiles and text corpora."""

__version__ = "0.1.0"
