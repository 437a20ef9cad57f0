"""Relational, modelling and scheduling operators."""
