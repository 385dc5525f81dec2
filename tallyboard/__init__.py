"""Reports over Spark tables: profiles, parameters, named outputs, shaping, export."""

__version__ = "0.1.0"
