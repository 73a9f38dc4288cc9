"""Marketing and sales analytics operators as PySpark DataFrame functions."""
