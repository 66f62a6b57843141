"""Explainable risk scoring for payment-like transactions, on Spark DataFrames."""
