"""Snapshots of source trees as DataFrames, and operators over them."""
