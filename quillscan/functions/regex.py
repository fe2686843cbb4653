"""Regular expressions written with Unicode classes in mind, for the JVM's engine."""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """Give ``\\w \\d \\s \\b`` their Unicode meaning, inside and outside of classes."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            plain = {"\\w": WORD, "\\d": r"\p{Nd}", "\\s": SPACE}.get(pair)
            if plain:
                out.append(plain if inside else f"[{plain}]")
            elif pair == "\\b" and not inside:
                out.append(EDGE)
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c == "[" and inside:
            c = "\\["
        out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def quoted(phrase: str) -> str:
    """A literal phrase as a case-insensitive pattern."""
    return "(?iu)" + "".join("\\" + c if not (c.isalnum() or c in " _" or ord(c) > 127) else c for c in phrase)
