"""Training-data operators: documents in, decisions or packed data out."""
