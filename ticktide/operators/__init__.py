"""Transformations of bar tables, DataFrame in and DataFrame out."""
