"""Readers, tile enumeration, and the lift of business tables to features, fields and pixels."""
