"""Formats as elements. A parser takes the content of one document and never raises: what fails becomes an error."""
