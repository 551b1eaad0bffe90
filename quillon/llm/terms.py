"""Terms of texts: runs of ASCII letters and digits and of all that is not ASCII, with only A-Z in lower case."""

from __future__ import annotations

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8; none of a null one."""
    return text.encode().translate(_LOWER).split() if text else []
