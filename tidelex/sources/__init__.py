"""Readers and writers of corpora and crawl state."""
