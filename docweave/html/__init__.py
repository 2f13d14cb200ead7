"""A tolerant HTML tree and what is done with it: normalisation, formulas, Markdown, navigation."""
