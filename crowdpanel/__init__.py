"""Event-impact panels, matched controls and effect estimates as Spark DataFrames.

Every public function takes DataFrames (or column names) and returns lazy
DataFrames; nothing is collected on the way. See README.md for the map from
operators to modules.
"""
