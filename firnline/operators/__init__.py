"""Operators: each public function takes DataFrames and returns a DataFrame."""
