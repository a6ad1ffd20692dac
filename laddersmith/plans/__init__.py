"""Whole plans: back-tests, searches, histories, exports."""
