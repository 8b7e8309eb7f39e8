"""Evidence-linking and reconciliation operators on Spark DataFrames."""
