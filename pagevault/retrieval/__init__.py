"""Search over documents and vectors: an inverted index in blocks, an inverted file of quantised residuals, fusion and evaluation of rankings."""
