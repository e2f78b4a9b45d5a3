"""Training-data operators: exact and near dedup, tokenizers, filters, packing. Nothing else in the library imports this."""
