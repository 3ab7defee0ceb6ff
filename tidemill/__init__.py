"""tidemill: retail event and order analytics expressed as Spark plans."""

__version__ = "0.1.0"
