"""chronoloom: evaluation and time-series analytics expressed as Spark plans."""
