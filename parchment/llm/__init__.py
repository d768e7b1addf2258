"""Training-data pipeline operators.

One module per operator; each exposes DataFrame-in, DataFrame-out functions.
``queries.py`` holds the thin registered queries and their SQL.  Nothing else
in the package imports from here.
"""
