"""Training-data operators: ten jobs over the documents table. Nothing else in the library imports this."""
