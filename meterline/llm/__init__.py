"""Operators that prepare text for model training. Nothing else in the library imports them."""
