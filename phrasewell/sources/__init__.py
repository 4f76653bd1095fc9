"""Corpus adapters and file scans."""
