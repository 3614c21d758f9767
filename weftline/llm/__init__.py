"""Operators for preparing training data: near duplicates, validity, documentation pairs, splitting, credentials,
generated files, nearest vectors, packing, mixing and language labels. Nothing outside this folder imports it."""
