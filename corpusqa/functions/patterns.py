"""Python regular expressions, written out so that Java reads them alike.

Python's ``\\w``, ``\\s``, ``\\d`` and ``\\b`` know Unicode; Java's do not unless
told, and its own Unicode mode draws the lines elsewhere (combining marks,
control characters).  So the classes are spelled out.
"""

from __future__ import annotations

# \w first: the ASCII test is the cheap one.
WORD = r"\w\p{L}\p{N}"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIGIT = r"\p{Nd}"
# Members of SPACE, for trim().
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
WORD_RUN = f"[{WORD}]+"
BEFORE_WORD = f"(?<![{WORD}])"
AFTER_WORD = f"(?![{WORD}])"

_CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}


def java(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Spell a Python pattern for Spark's regex functions.

    A ``\\b`` at the start of the pattern or of a group is taken as the start of
    a word, any other as the end of one, which holds when it touches a word
    character of the pattern.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in _CLASSES:
                out.append(_CLASSES[e] if in_class else f"[{_CLASSES[e]}]")
            elif e in "WSD" and not in_class:
                out.append(f"[^{_CLASSES[e.lower()]}]")
            elif e == "b" and not in_class:
                opening = not out or out[-1] in ("(", "|", "(?:")
                first = pattern[i + 2:i + 3]
                if opening and first.isascii() and first.isalpha():
                    # Try the letter before the boundary: it fails sooner.
                    out.append(f"{first}(?<![{WORD}]{first})")
                    i += 1
                else:
                    out.append(BEFORE_WORD if opening else AFTER_WORD)
            else:
                out.append(c + e)
            i += 2
            continue
        if pattern.startswith("(?:", i) and not in_class:
            out.append("(?:")
            i += 3
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "." and not in_class and not dotall:
            c = r"[^\n]"
        out.append(c)
        i += 1
    flags = ("iu" if ignore_case else "") + ("s" if dotall else "")
    return (f"(?{flags})" if flags else "") + "".join(out)


def literal(text: str) -> str:
    """Escape a literal for a Java pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|-/&~#" else c for c in text)
