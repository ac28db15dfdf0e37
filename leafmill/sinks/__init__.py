"""Sinks: documents as files, each written by one task and renamed when it is whole."""
