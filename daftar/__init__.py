"""daftar: corpus preparation for multilingual teaching documents, on Spark DataFrames."""
