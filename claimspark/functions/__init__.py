"""Column functions: text, dates, judge outputs, vectors and sequences. All are built-in expressions."""
