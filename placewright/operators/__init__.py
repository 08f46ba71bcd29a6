"""Operators over DataFrames: grid joins, graphs, networks, rules, planning, areas, models, verification."""
