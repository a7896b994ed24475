"""Column expressions: numbers, words, lines, page marks, names and triage rules."""
