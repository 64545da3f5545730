"""Operators from frames to frames: dataflow, joins, windows, intervals, graphs and alignment."""
