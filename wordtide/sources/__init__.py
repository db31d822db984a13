"""wordtide sources."""
