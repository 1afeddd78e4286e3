"""Relational operators: metrics, evaluation, resampling, ensembles, forecasting."""
