"""Registered queries and the views that they share."""
