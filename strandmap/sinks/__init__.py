"""Sinks: RDF files and CSV reports, with outputs that appear only when a program has succeeded."""
