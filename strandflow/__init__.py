"""strandflow: genomic sequence analytics as PySpark DataFrame operators."""
