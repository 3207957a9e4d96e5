"""Detection, baseline and inventory operators: DataFrames in, DataFrames out."""
