"""Operators on index tables: boolean retrieval, ranking, link analysis, snippets, crawl dataflow."""
