"""Bilinear encoding models of time series on Spark.

A target is explained by predictors that are convolved with temporal kernels; trial-level
gains may scale any of them.  Grids, alignment, conditioning and moments are DataFrame
plans; the small solves per unit run on per-trial moments in grouped Arrow functions.
"""
