"""Small binary formats: numbers of variable length, bit fields, language codes, legacy text."""

from __future__ import annotations

#: Languages of a Mobipocket header by their number's low ten bits (fixed values).
LOCALES = {1: "ar", 2: "bg", 3: "ca", 4: "zh", 5: "cs", 6: "da", 7: "de", 8: "el", 9: "en", 10: "es", 11: "fi", 12: "fr", 13: "he", 14: "hu", 15: "is", 16: "it", 17: "ja", 18: "ko", 19: "nl", 20: "no", 21: "pl", 22: "pt", 24: "ro", 25: "ru", 29: "sv", 30: "th", 31: "tr", 34: "uk"}
#: Signs of the PDF document encoding where it is not Latin-1 (fixed values).
PDF_SIGNS = {
    0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜", 0x80: "•", 0x81: "†", 0x82: "‡", 0x83: "…", 0x84: "—", 0x85: "–", 0x86: "ƒ", 0x87: "⁄", 0x88: "‹", 0x89: "›", 0x8A: "−", 0x8B: "‰",
    0x8C: "„", 0x8D: "“", 0x8E: "”", 0x8F: "‘", 0x90: "’", 0x91: "‚", 0x92: "™", 0x93: "ﬁ", 0x94: "ﬂ", 0x95: "Ł", 0x96: "Œ", 0x97: "Š", 0x98: "Ÿ", 0x99: "Ž", 0x9A: "ı", 0x9B: "ł", 0x9C: "œ", 0x9D: "š", 0x9E: "ž", 0xA0: "€",
}


def locale_of(code: int) -> str | None:
    """The language of a header's number, None for one that is not known."""
    return LOCALES.get(code & 0x3FF)


def varint(value: int) -> bytes:
    """A number in groups of seven bits, highest first; the last byte has its high bit set."""
    out = [value & 0x7F | 0x80]
    while value := value >> 7:
        out.append(value & 0x7F)
    return bytes(reversed(out))


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at ``at`` and the place after it; ``ValueError`` where it does not end."""
    value = 0
    for k in range(at, len(data)):
        value = value << 7 | data[k] & 0x7F
        if data[k] & 0x80:
            return value, k + 1
    raise ValueError("a number does not end")


def bits32(data: bytes, at: int) -> int:
    """The 32 bits from bit ``at`` on, zeros behind the end."""
    window = int.from_bytes(data[at // 8 : at // 8 + 5].ljust(5, b"\0"), "big")
    return window >> (8 - at % 8) & 0xFFFFFFFF


def pdf_text(data: bytes) -> str:
    """A PDF text string: UTF-16 or UTF-8 by its mark, else the document encoding; language escapes go."""
    if data.startswith((b"\xfe\xff", b"\xff\xfe")):
        text = data[2:].decode("utf-16-be" if data[0] == 0xFE else "utf-16-le", "replace")
    elif data.startswith(b"\xef\xbb\xbf"):
        text = data[3:].decode("utf-8", "replace")
    else:
        text = "".join(PDF_SIGNS.get(b) or chr(b) for b in data)
    parts = text.split("\x1b")
    return parts[0] + "".join(parts[2::2] if len(parts) % 2 else [*parts[2::2], ""])
