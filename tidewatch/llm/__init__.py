"""Training-data operators: each module holds one operator, its query and its tests' entry points.

Nothing outside this package imports it, so it can be removed as a whole.
"""
