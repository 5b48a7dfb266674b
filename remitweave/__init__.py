"""remitweave: settlement reconciliation analytics on Spark."""
