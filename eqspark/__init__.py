"""Analytics for frequency-response curves and parametric equalisation on Spark."""
