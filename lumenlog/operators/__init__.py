"""Rules, folds and fixpoints over DataFrames."""
