"""Filters, sorting, profiling, merging, evaluation: DataFrame in, DataFrame out."""
