"""Structured Streaming versions of import (T1), engagement (T2) and risk trend."""
