"""Scans: landed feed documents, repository JSON and web pages as one item shape."""
