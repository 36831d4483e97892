"""Whole plans: building trees, retrieving from them, answering."""
