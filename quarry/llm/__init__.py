"""Training-data operators (language ID, de-duplication, scoring, packing, search).

Nothing else in the library imports this subpackage.
"""
