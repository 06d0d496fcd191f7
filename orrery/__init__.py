"""Orrery: code-intelligence and knowledge-store analytics on Spark DataFrames."""
