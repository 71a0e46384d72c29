"""A task ledger as Spark DataFrames: reads, transitions and folds over a fixed schema."""
