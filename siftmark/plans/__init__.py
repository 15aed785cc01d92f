"""Bindings of the operators to tables, and the catalogue of registered queries."""
