"""tessera: a temporal property graph engine expressed in Spark DataFrames."""
