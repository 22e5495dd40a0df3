"""Training-data pipeline operators (search, mixing, scoring, dedup, sharding).

Nothing else in the library imports this subpackage.  Each operator lives in
its own module with a general interface; ``queries.py`` holds the thin
``opN_<name>`` digests and ``oracles.py`` their SQL.
"""
