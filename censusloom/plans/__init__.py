"""Whole jobs: the developer-survey analysis and its headline facts."""
