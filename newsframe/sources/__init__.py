"""Readers: driver tables, pages, feeds, stored records."""
