"""Billing, delivery and warehouse analytics on Spark DataFrames."""
