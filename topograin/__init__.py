"""topograin: set-at-a-time toponym resolution and corpus processing on Spark."""
