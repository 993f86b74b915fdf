"""riskloom: code-risk analytics and text-corpus operators on Spark DataFrames."""
