"""Globs and guards for patterns that callers bring."""

from __future__ import annotations

import re

#: Longest pattern that is taken.
MAX_PATTERN = 500


def risky(pattern: str) -> bool:
    """Whether a pattern may take exponential time: a repeated group that repeats or chooses inside, however deep."""
    if len(pattern) > MAX_PATTERN or re.search(r"(\.\*){3,}", pattern):
        return True
    inside, i = [False], 0  # of each open group, whether it repeats or chooses
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            end = re.compile(r"\[\^?\]?(?:[^\\\]]|\\.)*\]").match(pattern, i)
            i = end.end() - 1 if end else len(pattern)
        elif c == "(":
            inside.append(False)
        elif c == ")" and len(inside) > 1:
            held, again = inside.pop(), pattern[i + 1 : i + 2] in ("+", "*", "{")
            if held and again:
                return True
            inside[-1] |= held or again
        elif c in "+*{|":
            inside[-1] = True
        i += 1
    return False


def safe_pattern(pattern: str) -> str:
    """The pattern, if it compiles and is not risky; else ValueError."""
    if risky(pattern):
        raise ValueError("the pattern may take exponential time")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no pattern: {e}") from None
    return pattern


def compile_glob(glob: str) -> str:
    """An anchored regular expression of a glob: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
