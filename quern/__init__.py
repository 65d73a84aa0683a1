"""quern: a lazy, relation-aware query layer that compiles to Spark DataFrames."""
