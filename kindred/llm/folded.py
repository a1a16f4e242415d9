"""Words of texts in which only A-Z are lower-cased and all ASCII but letters and digits parts words."""

from __future__ import annotations

#: Every byte as it counts: A-Z lower-cased, ASCII other than letters and digits a space, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; none of a null."""
    return text.translate(FOLD).split() if text else []
