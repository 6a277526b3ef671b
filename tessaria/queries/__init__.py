"""Registered queries of the core and their equivalent SQL."""
