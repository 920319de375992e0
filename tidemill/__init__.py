"""Layered multi-tenant analytics on Spark: contracts, joins, marts, features, change
logs and streaming metrics as functions from DataFrames to DataFrames."""
