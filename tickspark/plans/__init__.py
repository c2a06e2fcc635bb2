"""Ready-made plans over the test tables."""
