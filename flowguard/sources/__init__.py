"""Flow tables, message streams and saved model packages."""
