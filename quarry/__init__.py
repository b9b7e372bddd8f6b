"""quarry: literal search, code navigation and change tracking over corpora, as Spark DataFrames."""
