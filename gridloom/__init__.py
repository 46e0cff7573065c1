"""gridloom: grid, placement and rule analytics as Spark plans."""

__version__ = "0.1.0"
