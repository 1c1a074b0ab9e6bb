"""Stages, profiles and the runner that folds them over a table of pages."""
