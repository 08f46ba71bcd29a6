"""Whole plans: chains of operators from drawing or requests to decisions."""
