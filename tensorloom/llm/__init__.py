"""Training-data operators over text corpora. Nothing outside this folder imports it."""
