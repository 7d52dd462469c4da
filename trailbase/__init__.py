"""A goal-driven crawl and corpus analytics engine on Spark DataFrames."""
