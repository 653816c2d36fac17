"""Search, evaluation and collections over DataFrames."""
