"""Command lines: python -m prefixlens.cli.analyse, .receive, .report."""
