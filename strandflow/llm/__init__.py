"""Training-data operators: thirteen corpus operators, each with a thin registered query."""
