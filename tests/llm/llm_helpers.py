"""What several tests of this folder need."""


def words(text):
    return (text or "").encode().split()


def alnum_words(text):
    """Words of lower-case letters and digits and all that isn't ASCII."""
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    keep = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in lowered)
    return keep.split()


# Null, empty, blank and symbol-only texts.
ODD_TEXTS = [None, "", " \n\t ", "*** ###", "é", "x"]
