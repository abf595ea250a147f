"""Operators on DataFrames of events, samples, histograms and fits."""
