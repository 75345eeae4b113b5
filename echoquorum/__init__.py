"""echoquorum: consensus analytics over crowd-sourced content fingerprints, on Spark DataFrames."""
