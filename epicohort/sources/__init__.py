"""Inputs and outputs: driver-table fixtures, scans, stage tables, result sinks."""
