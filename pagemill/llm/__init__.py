"""Training-data operators. Nothing else in pagemill imports this subpackage."""
