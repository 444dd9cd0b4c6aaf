"""Training-data operators: de-duplication, quality, language, secrets, mixing, tokenising and archives.

Nothing else in the package imports this subpackage.  ``queries`` registers one query for each operator.
"""
