"""Where texts and trees are read from and written to."""
