"""Web-archive analytics on Spark: capture classification, extraction, lineage and archive I/O as DataFrame operators."""
