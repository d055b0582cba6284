"""Whole plans: convert, validate, tile rendering, registered queries."""
