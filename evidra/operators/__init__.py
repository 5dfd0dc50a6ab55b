"""Relational operators over evidence, discussions, versions and scores."""
