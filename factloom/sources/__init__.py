"""Readers of tables, text folders and raw pages, and the graph's views over them."""
