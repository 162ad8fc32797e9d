"""Audits of how well AI agents can use a website, over crawl snapshots, as Spark DataFrames."""
