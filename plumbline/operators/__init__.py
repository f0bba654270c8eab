"""Relational operators: grid index, point-in-polygon join, statistics, table preparation, display queries."""
