"""Composed plans and bindings of generic tables to the domain tables."""
