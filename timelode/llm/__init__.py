"""Training-data preparation jobs. Nothing else in the library imports this subpackage."""
