"""The same transformations over streams."""
