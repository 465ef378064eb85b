"""Watershed data preparation as DataFrame jobs."""
