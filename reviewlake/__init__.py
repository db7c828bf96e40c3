"""Change-review analytics on Spark: evidence tables in, answers about all changes out."""
