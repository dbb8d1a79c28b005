"""The stateless part of the row pipeline over streams."""
