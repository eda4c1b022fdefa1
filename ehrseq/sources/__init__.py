"""Reading and writing of CDM tables, labels, sequences, vocabularies and metrics."""
