"""Self-healing structured extraction on Spark.

Page snapshots become typed records by declarative selectors; records are
normalised, deduplicated, validated and summed up in health reports; when
fields break, replacement selectors are generated, tested, scored and gated.
"""
