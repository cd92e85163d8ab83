"""lexshoal: n-gram statistics and language-model queries over tokenised corpora, on Spark DataFrames."""
