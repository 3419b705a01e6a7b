"""Registered queries and job drivers."""
