"""meshlight: a PySpark-native graph community-analytics engine."""

from __future__ import annotations

__version__ = "0.1.0"
