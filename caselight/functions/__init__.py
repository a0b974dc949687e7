"""Column helpers: presence rules, text and date cleaning, text quality, typed extraction, similarity."""
