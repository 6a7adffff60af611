"""Relational operators of the search engine: index, retrieval, results, corpus statistics, assistance, enrichment."""
