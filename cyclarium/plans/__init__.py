"""Declarative task lists and how they become one DataFrame plan."""
