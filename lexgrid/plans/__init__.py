"""Query language."""
