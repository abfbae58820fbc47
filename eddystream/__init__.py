"""Density clustering over sliding windows of point streams, on Spark."""
