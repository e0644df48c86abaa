"""Whole-log plans: replay, audit, scorecard."""
