"""Training-data operators: dedup, tokenisation, scoring, scanning and packing of documents."""
