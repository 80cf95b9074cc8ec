"""Training-data operators: ten methods over document, page and benchmark tables."""
