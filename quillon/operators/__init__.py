"""Operators over document columns: shredding, construction and aggregation."""
