"""Operators that prepare text and vectors for model training, each a DataFrame -> DataFrame job."""
