"""DataFrame-to-DataFrame operators, generic over column names."""
