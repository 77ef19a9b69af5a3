"""A knowledge-analytics engine on Spark: documents in, evidence out."""
