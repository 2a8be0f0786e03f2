"""Training-data operators: tokenising, filtering, deduplication, masking, formatting.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; Python code runs
only inside tasks, over Arrow batches of bounded size.
"""
