"""Training-data operators: deduplication, filters, scoring, extraction and packing of text at corpus scale."""
