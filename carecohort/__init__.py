"""Clinical cohort building and risk-equation validation on Spark DataFrames."""
