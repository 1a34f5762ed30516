"""reviewlab: review sentiment analytics as Spark DataFrame jobs.

sources    scans with explicit schemas, splits, row ids, samples, sinks
functions  fixed values, SQL-dialect helper, tokenizer and Porter rules
operators  text, eda, splits, bayes, features, selection, classifiers,
           lexicon, inference, evaluation, retrieval
plans      registered queries and their DuckDB oracle SQL
streaming  file streams scored against static tables
"""
