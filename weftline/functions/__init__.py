"""Column functions and registered UDFs."""
