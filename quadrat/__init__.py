"""Point-label dataset preparation and classifier evaluation as Spark plans."""

__version__ = "0.1.0"
