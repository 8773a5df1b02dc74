"""ledgerlight: market-data analytics expressed as Spark plans."""
