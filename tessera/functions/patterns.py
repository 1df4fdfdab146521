"""Patterns of the linear-time dialect, for Java.

The two dialects write many things alike and mean something else, so a pattern is read item by item.
What has no Java form here (look-around, back references, ungreedy flags, single bytes and others
that the linear-time dialect lacks or that are not translated) raises while the plan is built.
"""

from __future__ import annotations

import re

from tessera.errors import EngineError

_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\d", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
_CONTROLS = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}
_CODES = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}
#: White space has no vertical tab; word boundaries are of ASCII words.
_SPACE, _NO_SPACE = r"\t\n\f\r ", r"\x{0}-\x08\x0B\x0E-\x1F!-\x{10FFFF}"
_AFTER, _BEFORE = "(?<=[0-9A-Za-z_])", "(?=[0-9A-Za-z_])"
_NOT_AFTER, _NOT_BEFORE = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_BOUNDARY = f"(?:{_AFTER}{_NOT_BEFORE}|{_NOT_AFTER}{_BEFORE})"
_NO_BOUNDARY = f"(?:{_AFTER}{_BEFORE}|{_NOT_AFTER}{_NOT_BEFORE})"
_MOST_REPEATS, _LAST_CODE = 1000, 0x10FFFF


def _quoted(code: int) -> str:
    """One code point as a literal, in or out of a class."""
    c = chr(code)
    return c if c.isalnum() or c in " _\"'/,:;<>=@%!" else f"\\x{{{code:X}}}"


def _negated(known: str) -> str:
    """The complement of a class escape."""
    return f"\\{known[1].upper()}{known[2:]}"


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups = pattern, 0, 0
        self.flags: list[frozenset[str]] = [frozenset()]  # of the open groups

    def wrong(self, what: str) -> EngineError:
        return EngineError(f"pattern {self.pattern!r}, at {self.at}: {what}")

    def here(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def taken(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern, re.ASCII).match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def code(self) -> int | None:
        """An escape that stands for one code point, if one is here."""
        if found := self.taken(r"\\x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})"):
            code = int(found[1] or found[2], 16)
            if code > _LAST_CODE:
                raise self.wrong("no such code point")
            return code
        if found := self.taken(r"\\(0[0-7]{0,2}|[1-7][0-7]{1,2})"):
            return int(found[1], 8)
        if found := self.taken(r"\\([afnrtv])"):
            return _CODES[found[1]]
        if found := self.taken(r"\\([^0-9A-Za-z])"):
            if ord(found[1]) > 127:
                raise self.wrong("an escaped letter")
            return ord(found[1])
        return None

    def class_escape(self, inside: bool) -> str | None:
        """A class that is written as an escape, if one is here."""
        if found := self.taken(r"\\([dDwW])"):
            return found[0]
        if found := self.taken(r"\\([sS])"):
            body = _SPACE if found[1] == "s" else _NO_SPACE
            return body if inside else f"[{body}]"
        if found := self.taken(r"\\([pP])(?:([A-Z])|\{(\^?)([A-Za-z_]+)\})"):
            name, no = found[2] or found[4], (found[1] == "P") != bool(found[3])
            if name == "Any":
                if no:
                    raise self.wrong("a class of nothing")
                return r"\x{0}-\x{10FFFF}" if inside else r"[\x{0}-\x{10FFFF}]"
            return f"\\{'P' if no else 'p'}{{{name if len(name) <= 2 and name != "Yi" else 'Is' + name}}}"
        return None

    def bracket(self) -> str:
        """A class in brackets, after its opening one."""
        out = ["["]
        if self.taken(r"\^"):
            out.append("^")
        first = True
        while first or self.here() != "]":
            if not self.here():
                raise self.wrong("a class is not closed")
            first = False
            if found := self.taken(r"\[:(\^?)(\w+):\]"):
                if found[2] not in _POSIX:
                    raise self.wrong(f"no class {found[2]!r}")
                out.append(_negated(_POSIX[found[2]]) if found[1] else _POSIX[found[2]])
                continue
            if (known := self.class_escape(True)) is not None:
                out.append(known)
                continue
            low = self.one()
            if self.here() == "-" and self.here(2) not in ("-", "-]"):
                self.at += 1
                high = self.one()
                if high < low:
                    raise self.wrong("a range that runs back")
                out.append(f"{_quoted(low)}-{_quoted(high)}")
            else:
                out.append(_quoted(low))
        self.at += 1
        return "".join([*out, "]"])

    def one(self) -> int:
        """One code point of a class."""
        if self.here() == "\\":
            code = self.code()
            if code is None:
                raise self.wrong("an escape that is not translated")
            return code
        self.at += 1
        return ord(self.pattern[self.at - 1])

    def group(self) -> str:
        """The opening of a group, or a group of flags alone."""
        flags = self.flags[-1]
        if self.taken(r"\(\?P?<(\w+)>"):
            self.groups += 1
            self.flags.append(flags)
            return "("
        if found := self.taken(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])"):
            on, off, end = found.groups()
            if set(on + (off or "")) - set("ims"):
                raise self.wrong(f"flags {found[0]!r} are not translated")
            flags = flags | set(on) - set(off or "")
            flags -= set(off or "")
            text = "iu" * ("i" in flags) + "s" * ("s" in flags)
            away = "iu" * ("i" not in flags) + "s" * ("s" not in flags)
            java = f"(?{text}" + (f"-{away}" if away else "") + end
            if end == ")":
                self.flags[-1] = flags
            else:
                self.flags.append(flags)
            return java
        if self.taken(r"\(\?"):
            raise self.wrong("a group that the dialect lacks")
        self.at += 1
        self.groups += 1
        self.flags.append(flags)
        return "("

    def repeat(self) -> str | None:
        if found := self.taken(r"([*+?])(\??)"):
            return found[0]
        if found := self.taken(r"\{(\d+)(,?)(\d*)\}(\??)"):
            low, high = int(found[1]), int(found[3] or found[1])
            if max(low, high) > _MOST_REPEATS or high < low:
                raise self.wrong("a count out of range")
            return found[0]
        return None

    def translated(self) -> str:
        out: list[str] = []
        can_repeat = False
        while c := self.here():
            many = "m" in self.flags[-1]
            if (repeat := self.repeat()) is not None:
                if not can_repeat:
                    raise self.wrong("nothing to repeat, or repeated twice")
                out.append(repeat)
                can_repeat = False
                continue
            can_repeat = True
            if c == "(":
                out.append(self.group())
                can_repeat = False
            elif c == ")":
                if len(self.flags) == 1:
                    raise self.wrong("a bracket that nothing opened")
                self.flags.pop()
                self.at += 1
                out.append(c)
            elif c == "[":
                self.at += 1
                out.append(self.bracket())
            elif c == "\\":
                if found := self.taken(r"(?s)\\Q(.*?)(?:\\E|\Z)"):
                    out += [_quoted(ord(x)) for x in found[1]]
                    can_repeat = bool(found[1])
                elif found := self.taken(r"\\([AzbB])"):
                    out.append({"A": r"\A", "z": r"\z", "b": _BOUNDARY, "B": _NO_BOUNDARY}[found[1]])
                elif (known := self.class_escape(False)) is not None:
                    out.append(known)
                elif (code := self.code()) is not None:
                    out.append(_quoted(code))
                else:
                    raise self.wrong("an escape that is not translated")
            else:
                self.at += 1
                if c == "^":
                    out.append(r"(?<![^\n])" if many else r"\A")
                elif c == "$":
                    out.append(r"(?![^\n])" if many else r"\z")
                elif c == "|":
                    out.append(c)
                    can_repeat = False
                else:
                    out.append(c if c == "." else _quoted(ord(c)))
        if len(self.flags) > 1:
            raise self.wrong("a group is not closed")
        return "".join(out)


def java_pattern(pattern: str) -> tuple[str, int]:
    """The pattern for Java, and the number of its groups. Only a line feed ends a line. An empty
    match at the end of the match before it is none, as in the linear-time dialect, and none starts
    inside a surrogate pair."""
    reader = _Reader(pattern)
    body = reader.translated()
    return rf"(?d)(?![\x{{DC00}}-\x{{DFFF}}])(?>{body})(?:(?!\G)|(?<![\x{{0}}-\x{{10FFFF}}]))", reader.groups


def java_replacement(replacement: str, groups: int) -> str:
    r"""``\1`` to ``$1``; a plain ``$`` stays a dollar sign, and a digit after a group is a digit."""
    out, at, after_group = [], 0, False
    while at < len(replacement):
        c = replacement[at]
        at += 1
        if c == "\\":
            follow = replacement[at : at + 1]
            at += 1
            if follow and follow in "0123456789":
                if int(follow) > groups:
                    raise EngineError(f"the pattern has no group {follow}")
                out.append(f"${follow}")
            elif follow == "\\":
                out.append("\\\\")
            else:
                raise EngineError(f"replacement {replacement!r}: a backslash before neither a digit nor another")
            after_group = follow != "\\"
            continue
        out.append("\\$" if c == "$" else f"\\{c}" if after_group and c.isdigit() else c)
        after_group = False
    return "".join(out)
