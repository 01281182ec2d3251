"""Column functions: text cleaning, words for numbers, readings of written forms."""
