"""quillspark: scripture-markup analytics as ordinary Spark DataFrames."""
