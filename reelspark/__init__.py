"""reelspark: scene retrieval and training-data operators as Spark plans."""
