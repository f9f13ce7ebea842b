"""Words of the contracts, by regular expressions."""

import re

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(ASCII_LOWER))
