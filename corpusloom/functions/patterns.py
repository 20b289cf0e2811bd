"""Regular expressions written for JavaScript, run by the JVM."""

from __future__ import annotations

import re

FLAGS = {"i": "i", "m": "m", "s": "s", "d": "", "g": "", "u": "", "y": ""}


def to_java(pattern: str, flags: str = "") -> str:
    """The same pattern for Java: '$' means the very end unless multi-line, '[^]' means anything."""
    if any(f not in FLAGS for f in flags) or len(set(flags)) != len(flags):
        raise ValueError(f"unknown or repeated flag in {flags!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("/" if pattern[i + 1] == "/" else pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            out.append("\\[" if c == "[" else c)
        elif pattern.startswith("[^]", i):
            out.append("[\\s\\S]")
            i += 3
            continue
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "$" and "m" not in flags:
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    switch = "".join(sorted(FLAGS[f] for f in flags))
    return (f"(?{switch})" if switch else "") + ("\\A(?:" if "y" in flags else "") + "".join(out) + (")" if "y" in flags else "")


def check(pattern: str, flags: str = "") -> str:
    """to_java, after a check that the pattern compiles at all."""
    java = to_java(pattern, flags)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"\\k<(\w+)>", r"(?P=\1)", java))).replace("\\p{L}", "x").replace("\\p{N}", "1"))
    except re.error as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from error
    return java


def literal(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\/-])", r"\\\1", text)


#: What \\s means in JavaScript, as the inside of a class.
_SPACE = "\\t\\n\\x0b\\f\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def to_python(pattern: str, flags: str = "") -> re.Pattern:
    """The same pattern for Python, for positions of matches: ASCII words and digits, '$' at the very end unless multi-line."""
    check(pattern, flags)
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\" and len(two) == 2:
            named = re.match(r"\\k<(\w+)>", pattern[i:])
            if named:
                out.append(f"(?P={named[1]})")
                i += named.end()
                continue
            out.append((_SPACE if inside else f"[{_SPACE}]") if two == "\\s" else f"[^{_SPACE}]" if two == "\\S" and not inside else "/" if two == "\\/" else two)
            i += 2
            continue
        if not inside and pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        if not inside and re.match(r"\(\?<[A-Za-z_]", pattern[i:]):
            out.append("(?P<")
            i += 3
            continue
        inside = c == "[" or inside and c != "]"
        out.append("\\[" if c == "[" and out and inside and pattern[i - 1 : i] != "\\" and _open(pattern, i) else "\\Z" if c == "$" and not inside and "m" not in flags else c)
        i += 1
    bits = re.ASCII | (re.IGNORECASE if "i" in flags else 0) | (re.MULTILINE if "m" in flags else 0) | (re.DOTALL if "s" in flags else 0)
    return re.compile("".join(out), bits)


def _open(pattern: str, at: int) -> bool:
    """Whether a class is open before this place."""
    inside, i = False, 0
    while i < at:
        if pattern[i] == "\\":
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        i += 1
    return inside
