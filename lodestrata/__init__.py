"""Level-of-detail geospatial tables on Spark."""
