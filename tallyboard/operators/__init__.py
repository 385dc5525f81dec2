"""Operators over DataFrames: profile, status, options, shaping, export."""
