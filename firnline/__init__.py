"""Area monitoring from imagery as Spark DataFrame operators.

Everything takes and returns DataFrames keyed by outline (``entry_id``),
acquisition (``image_id``) and cell (``y``, ``x``).
"""
