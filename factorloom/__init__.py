"""factorloom: cross-sectional panel analytics on PySpark DataFrames."""
