"""A SPARQL 1.1 engine on Spark DataFrames, and operators for building training corpora."""
