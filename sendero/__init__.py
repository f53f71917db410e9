"""Sendero: rural address, place search and road network analytics on Spark."""
