"""wordtide operators."""
