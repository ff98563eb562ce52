"""A PySpark-native engine for text corpora: cleaning, pairing, auditing, scoring, retrieval and modelling on DataFrames."""
