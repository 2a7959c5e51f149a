"""Sextant: DataFrame operators over software-delivery data."""
