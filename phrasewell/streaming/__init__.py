"""Keeping an index fresh."""
