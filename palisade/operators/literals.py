"""Texts that a pattern cannot match without: a cheap test that never says no to a match.

A pattern is read into its branches, groups and repeats. A run of plain characters that every match has to contain is
required; of a choice, one of the branches' texts is. Whatever the reader does not know for sure requires nothing.
"""

from __future__ import annotations

import re

LEAST, MOST = 3, 40
ZERO_WIDTH = "bBAZzG"
#: Escapes that stand for one of several characters, or for one that is not worth a text.
OPEN = "dDwWsShHvVRXtnrfae"
FLAGS = re.compile(r"\(\?([imsd]*)(?:-([imsd]*))?([:)])")
REPEAT = re.compile(r"(?:\*|\+|\?|\{(\d+)(,?)(\d*)\})[?+]?")
LOOK = re.compile(r"\(\?<?[=!]")
GROUP = re.compile(r"\((?:\?(?:>|<[A-Za-z][A-Za-z0-9]*>)|(?!\?))")


class Unknown(Exception):
    """Syntax that the reader does not know for sure."""


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.text, self.at = pattern, 0
        self.local = True  # nothing that depends on what lies outside of a match, or on an earlier choice

    def peek(self, text: str) -> bool:
        return self.text.startswith(text, self.at)

    def choice(self) -> frozenset[str] | None:
        """Texts of which each match holds one, up to the end of a group; None if there are none."""
        found = [self.branch()]
        while self.peek("|"):
            self.at += 1
            found.append(self.branch())
        if any(f is None for f in found):
            return None
        every = frozenset().union(*found)
        return every if len(every) <= MOST else None

    def branch(self) -> frozenset[str] | None:
        runs, run = [], ""
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            plain, inner = self.item()
            repeat = REPEAT.match(self.text, self.at)
            if repeat:
                self.at = repeat.end()
                self.local &= not (len(repeat.group()) > 1 and repeat.group().endswith("+"))
                least = 1 if repeat.group().startswith("+") else int(repeat.group(1) or 0)
                if least and plain is not None:
                    run += plain
                runs += [frozenset([run])] if run else []
                run = ""
                if least and inner:
                    runs.append(inner)
            elif plain is not None:
                run += plain
            else:
                runs += [frozenset([run])] if run else []
                run = ""
                if inner:
                    runs.append(inner)
        runs += [frozenset([run])] if run else []
        good = [r for r in runs if min(map(len, r)) >= LEAST]
        return max(good, key=lambda r: (min(map(len, r)), -len(r), sorted(r)), default=None)

    def item(self) -> tuple[str | None, frozenset[str] | None]:
        """A plain character in lower case, or the texts that an item requires, or neither."""
        ch = self.text[self.at]
        if ch == "(":
            return None, self.group()
        if ch == "[":
            return self.chars(), None
        if ch == "\\":
            return self.escape(), None
        if ch in "*+?{}":
            raise Unknown(ch)
        self.at += 1
        return (None if ch in ".^$" or not ch.isascii() else ch.lower()), None

    def group(self) -> frozenset[str] | None:
        flags, looks = FLAGS.match(self.text, self.at), LOOK.match(self.text, self.at)
        opened = flags or looks or GROUP.match(self.text, self.at)
        if not opened:
            raise Unknown(self.text[self.at : self.at + 4])
        self.at = opened.end()
        self.local &= not (looks or opened.group() == "(?>" or (flags and flags.group(2) is not None))
        if flags and flags.group(3) == ")":
            return None
        inner = self.choice()
        if not self.peek(")"):
            raise Unknown("open group")
        self.at += 1
        return None if looks else inner

    def chars(self) -> None:
        """Past a class. Classes within classes and quotes are read differently by different engines."""
        end = self.at + 1
        if self.text.startswith("^", end):
            end += 1
        first = end
        while end < len(self.text) and self.text[end] != "]":
            if self.text[end] == "[" or self.text.startswith(("&&", "\\Q", "\\E"), end):
                raise Unknown("class")
            end += 2 if self.text[end] == "\\" else 1
        if end == first or end >= len(self.text):
            raise Unknown("class")
        self.at = end + 1

    def escape(self) -> str | None:
        if self.at + 1 >= len(self.text):
            raise Unknown("\\")
        ch = self.text[self.at + 1]
        if ch in "pP":
            named = re.compile(r"\{[^{}]*\}|[A-Z]").match(self.text, self.at + 2)
            if not named:
                raise Unknown("\\p")
            self.at = named.end()
            return None
        if not (ch in ZERO_WIDTH or ch in OPEN or (ch.isascii() and not ch.isalnum())):
            raise Unknown(f"\\{ch}")
        self.local &= ch not in ZERO_WIDTH or ch in "bB"
        self.at += 2
        return ch if not ch.isalnum() else None


def _read(pattern: str) -> tuple[frozenset[str] | None, bool]:
    reader = _Reader(pattern)
    try:
        found = reader.choice()
    except (Unknown, RecursionError):
        return None, False
    whole = reader.at == len(reader.text)
    return (found or None) if whole else None, whole and reader.local


def required_texts(pattern: str) -> list[str] | None:
    """Lower-case texts of which every match of a JVM pattern holds one, whatever its case; None if that is not known.

    Comments and Unicode case (flags x, u and U), quotes, codes, back references and conditions give None.
    """
    found, _ = _read(pattern)
    return sorted(found) if found else None


def matches_in_text(pattern: str) -> bool:
    """Whether a JVM pattern (multi-line) that matches in a line is sure to match in a text that holds the line.

    Not with look-around, ends of the text, possessive or atomic parts, or flags that are switched off.
    """
    return _read(pattern)[1]
