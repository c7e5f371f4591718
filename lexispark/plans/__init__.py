"""Whole detection plans and their configuration."""
