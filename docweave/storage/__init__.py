"""Markdown to wiki storage markup and back, formula upgrade, and checks of storage markup."""
