"""Operators for preparing training data at corpus size.  Nothing else in the library imports this folder."""
