"""Jobs on Spark DataFrames that keep a large company list clean and complete."""
