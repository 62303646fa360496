"""Distributed writers; no row passes through the driver."""
