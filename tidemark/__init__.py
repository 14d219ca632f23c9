"""tidemark: time-series research, decision and ledger queries as Spark DataFrame operators."""
