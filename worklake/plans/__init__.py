"""Whole plans built from the operators: the daily run, the views, the dashboard shapes."""
