"""Helpers that shape plans: shared scratch tables and checked broadcasts."""
