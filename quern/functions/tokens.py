"""Token classes. The letters' class takes in { | } ~ DEL and all past ASCII, as what is counted depends on it."""

ALPHA = r"[A-Za-z\x{7B}-\x{10FFFF}]+"
OTHER = r"[^A-Za-z\x{7B}-\x{10FFFF} \n\t]+"
MAX_KEY_BYTES = 32


def in_set(col: str, chars: str) -> str:
    """An SQL expression for how many letters of col are in a set; chars has no quote."""
    return f"length({col}) - length(translate({col}, '{chars}', ''))"
