"""Regular expressions written once for Java and RE2 with Unicode meaning.

`\\s`, `\\d` and `.` mean different things in the two engines (ASCII or Unicode, and
which characters end a line), so they are spelled out as explicit classes.
"""

from __future__ import annotations

import re

# Fixed value: the characters that count as white space.
WHITESPACE = "".join(chr(c) for c in [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
])
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
# White-space runs that are not already a single blank; replacing only these leaves most words alone.
UNEVEN_SPACE = rf"[{SPACE.replace('-\\x{20}', '-\\x{1f}')}][{SPACE}]*| [{SPACE}]+"


def portable(pattern: str) -> str:
    """Spell out `\\s`, `\\d` and `.` so that Java and RE2 match the same text."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif two == r"\d":
            out.append(DIGIT)
        elif two.startswith("\\"):
            out.append(two)
        else:
            c = pattern[i]
            in_class = c == "[" or (in_class and c != "]")
            out.append("[^\\n]" if c == "." and not in_class else c)
            i += 1
            continue
        i += 2
    return "".join(out)


def ignore_case(pattern: str) -> str:
    """Portable pattern for Java, ignoring case over Unicode."""
    return "(?iu)" + portable(pattern)


def lower_case(pattern: str) -> str:
    """Portable pattern with its letters in lower case, for text from `lower_fold`; escapes such as `\\p{Nd}` stay."""
    return re.sub(r"\\p\{\w+\}|\\.|[A-Z]", lambda m: m[0].lower() if len(m[0]) == 1 else m[0], portable(pattern))
