"""wordtide functions."""
