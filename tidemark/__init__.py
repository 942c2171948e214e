"""tidemark: signal analytics over text and event records, expressed as Spark plans."""
