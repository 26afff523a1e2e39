"""Training-data pipeline operators.

One module per operator; nothing outside this folder imports it. The
registered queries and their SQL are in ``queries.py``.
"""
