"""Intermediate tables in the shared folder."""

from __future__ import annotations

from anchorline.session import stored

__all__ = ["stored"]
