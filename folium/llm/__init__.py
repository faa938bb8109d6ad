"""Training-data preparation operators. Nothing else in the package imports this subpackage."""
