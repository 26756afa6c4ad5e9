"""Operators for training-data pipelines: formatting, packing, filtering, mixing, search and scans."""
