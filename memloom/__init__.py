"""memloom: an evidence engine for conversational memory on PySpark DataFrames."""
