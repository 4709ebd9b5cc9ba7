"""Reading and writing corpora, benchmarks, scores and results."""
