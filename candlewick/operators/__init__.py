"""Operators on bars: each takes a DataFrame and returns one. Series are the rows of equal ``keys``, ordered by date."""
