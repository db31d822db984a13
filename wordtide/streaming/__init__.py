"""wordtide streaming."""
