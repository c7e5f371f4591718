"""Column functions: text normalisation, statistics, scripts, tags, proper nouns."""
