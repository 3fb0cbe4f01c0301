"""Document analytics on Spark: block normalisation, classification, regions, merging, packing, quality gates, sessions."""
