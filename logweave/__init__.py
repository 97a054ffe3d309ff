"""logweave: tagged-record log analytics expressed as Spark DataFrame plans."""
