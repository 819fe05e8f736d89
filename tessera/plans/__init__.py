"""The queries of the driver contract."""
