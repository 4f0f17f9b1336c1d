"""Functions that Spark lacks, as column expressions."""
