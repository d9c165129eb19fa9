"""coinfold: crypto-ledger tax and PnL analytics expressed as PySpark DataFrame jobs."""
