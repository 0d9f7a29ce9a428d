"""Rewrite a Python regular expression in the dialect Spark's JVM functions use.

The signature catalogue is written in Python's dialect.  The two dialects agree
on almost everything; they differ in what ``\\w \\d \\s \\b`` mean on Unicode
text, in how groups are named, and in a few escapes.  The rewrite happens once
per pattern on the driver, so that matching itself stays inside the JVM.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

# What Python's str patterns call white space.
SPACE_RANGES = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_RANGES = r"\p{L}\p{N}_"

_WORD = f"[{WORD_RANGES}]"
_OUTSIDE = {
    "w": _WORD,
    "W": f"[^{WORD_RANGES}]",
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
    "s": f"[{SPACE_RANGES}]",
    "S": f"[^{SPACE_RANGES}]",
    "b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
    "Z": r"\z",
    "v": r"\x0b",
}
_INSIDE = {**_OUTSIDE, "w": WORD_RANGES, "s": SPACE_RANGES, "b": r"\x08"}
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_FLAGS = re.compile(r"\(\?([aiLmsux]+)(-[imsx]+)?([:)])")


class RegexDialectError(ValueError):
    """The pattern uses a construct that has no JVM equivalent."""


def to_java(pattern: str) -> str:
    """Return the JVM pattern that finds exactly what Python's ``re`` finds."""
    compiled = re.compile(pattern)
    out: list[str] = []
    pos, in_class, negated = 0, False, False
    while pos < len(pattern):
        char = pattern[pos]
        if char == "\\":
            text, pos = _escape(pattern, pos, in_class, negated)
            out.append(text)
            continue
        if in_class:
            if char == "]":
                in_class = False
            out.append("\\" + char if char in "[&" else char)
        elif char == "[":
            in_class = True
            negated = pattern.startswith("^", pos + 1)
            opening = "[^" if negated else "["
            pos += len(opening)
            if pattern.startswith("]", pos):  # a leading ']' is a literal
                opening += r"\]"
                pos += 1
            out.append(opening)
            continue
        elif char == "(":
            text, pos = _group(pattern, pos, compiled.groupindex)
            out.append(text)
            continue
        elif char == "{":
            found = _QUANTIFIER.match(pattern, pos)
            if found and found.group(0) not in ("{}", "{,}"):
                low, comma, high = found.groups()
                out.append("{%s%s%s}" % (low or "0", comma, high))
                pos = found.end()
                continue
            out.append(r"\{")
        else:
            out.append(char)
        pos += 1
    return "".join(out)


def _escape(pattern: str, pos: int, in_class: bool, negated: bool) -> tuple[str, int]:
    letter = pattern[pos + 1]
    if letter in "uU":
        width = 4 if letter == "u" else 8
        return r"\x{%s}" % pattern[pos + 2 : pos + 2 + width], pos + 2 + width
    if letter == "N":
        raise RegexDialectError("named characters are not supported")
    if in_class and negated and letter in "WS":
        raise RegexDialectError(f"\\{letter} inside a negated class is not supported")
    table = _INSIDE if in_class else _OUTSIDE
    return table.get(letter, "\\" + letter), pos + 2


def _group(pattern: str, pos: int, names: dict[str, int]) -> tuple[str, int]:
    if pattern.startswith("(?P<", pos):
        return "(", pattern.index(">", pos) + 1
    if pattern.startswith("(?P=", pos):
        end = pattern.index(")", pos)
        return r"(?:\%d)" % names[pattern[pos + 4 : end]], end + 1
    if pattern.startswith("(?#", pos):
        return "", pattern.index(")", pos) + 1
    if pattern.startswith("(?(", pos):
        raise RegexDialectError("conditional groups are not supported")
    flags = _FLAGS.match(pattern, pos)
    if flags:
        letters, off, end = flags.groups()
        if set(letters) & set("aLx"):
            raise RegexDialectError(f"flags '{letters}' are not supported")
        letters = letters.replace("u", "")
        if "i" in letters:
            letters += "u"
        return f"(?{letters}{off or ''}{end}", flags.end()
    return "(", pos + 1


def search_pattern(pattern: str, ahead: str = "") -> str:
    """JVM form of ``re.compile(pattern, re.MULTILINE | re.DOTALL)``.

    The ``d`` flag makes a line feed the only line terminator, as in Python.
    ``ahead`` is a JVM look-ahead that every match satisfies.
    """
    body = to_java(pattern)
    return f"(?msd){ahead}(?:{body})" if ahead else "(?msd)" + body


# So many turns of repeated groups, one inside the other, fit any stack.
MOST_TURNS = 500
_REPEATED = re.compile(r"(?:[*+]|\{(\d*)(?:(,)(\d*))?\})([+]?)")


def repeats_groups(pattern: str) -> bool:
    """Some group may take more than ``MOST_TURNS`` turns, so that the JVM's engine needs a deep stack for it.

    Possessive repeats give nothing back and need none.
    """
    turns = [0]  # of the groups closed so far in each open group
    pos, in_class = 0, False
    while pos < len(pattern):
        char = pattern[pos]
        if char == "\\":
            pos += 2
            continue
        if in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
            pos += 2 if pattern.startswith("^", pos + 1) else 1
            pos += pattern.startswith("]", pos)  # a leading ']' is a literal
            continue
        elif char == "(":
            turns.append(0)
        elif char == ")" and len(turns) > 1:
            inner = turns.pop()
            found = _REPEATED.match(pattern, pos + 1)
            if found and found.group(0) != "{}" and not found.group(4):
                low, comma, high = found.group(1, 2, 3)
                most = int(high) if high else int(low) if low and not comma else MOST_TURNS + 1
                inner = most * (1 + inner)
            if inner > MOST_TURNS:
                return True
            turns[-1] = max(turns[-1], inner)
        pos += 1
    return False


_FEED = ord("\n")
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT)
_CHARACTERS = (op.LITERAL, op.NOT_LITERAL, op.ANY, op.IN)


def counts_no_line_feeds(pattern: str, gap: int) -> bool:
    """Runs of ``gap`` or more line feeds are all the same to the pattern, but for the length of a match.

    Line feeds may only be taken by unbounded repeats of one character outside
    other repeats, and neither at an end of a match nor inside the group
    ``secret``: then a match takes all of a run or nothing of it, and takes a
    longer one in the same way.  False where that is not plain to see.
    """
    tree = parser.parse(pattern, re.M | re.S)
    secret = tree.state.groupdict.get("secret")
    least = _least_feeds(tree, secret)
    return least is not None and least < gap and _ends_firm(tree, 1) and _ends_firm(tree, -1)


def within_lines(pattern: str) -> bool:
    """What the pattern finds in a line depends on that line alone; False where that is not plain to see."""
    return not _leaves_line(parser.parse(pattern, re.M | re.S))


def _leaves_line(items: parser.SubPattern) -> bool:
    """Some part, or what it looks at, may be a line feed or an end of the text."""
    for kind, value in items:
        if kind in _CHARACTERS:
            found = _takes_feed(kind, value)
        elif kind is op.AT:
            found = value in (op.AT_BEGINNING_STRING, op.AT_END_STRING)
        elif kind in _REPEATS:
            found = _leaves_line(value[2])
        elif kind is op.SUBPATTERN:
            found = _leaves_line(value[-1])
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            found = _leaves_line(value[1])
        elif kind is op.BRANCH:
            found = any(_leaves_line(branch) for branch in value[1])
        else:
            found = True
        if found:
            return True
    return False


def _takes_feed(kind: object, value: object) -> bool:
    """A character item matches a line feed."""
    if kind is op.LITERAL:
        return value == _FEED
    if kind is op.NOT_LITERAL:
        return value != _FEED
    if kind is op.ANY:
        return True
    negated = value[0][0] is op.NEGATE
    held = any(
        (k is op.LITERAL and v == _FEED)
        or (k is op.RANGE and v[0] <= _FEED <= v[1])
        or (k is op.CATEGORY and v in (op.CATEGORY_SPACE, op.CATEGORY_NOT_DIGIT, op.CATEGORY_NOT_WORD))
        for k, v in value
    )
    return held != negated


def _least_feeds(items: parser.SubPattern, secret: int | None) -> int | None:
    """Line feeds that the repeats take at least, all summed up; None where feeds may be counted."""
    total = 0
    for kind, value in items:
        if kind in _CHARACTERS:
            least = None if _takes_feed(kind, value) else 0
        elif kind is op.AT:
            least = 0
        elif kind in _REPEATS:
            low, high, body = value
            single = len(body) == 1 and body[0][0] in _CHARACTERS
            if single and high is op.MAXREPEAT and _takes_feed(*body[0]):
                least = int(low)
            else:
                least = _least_feeds(body, secret)
                if least is not None and high != 1 and _has_feeds(body):
                    least = None
        elif kind is op.SUBPATTERN:
            least = _least_feeds(value[-1], secret)
            if value[0] is not None and value[0] == secret and _has_feeds(value[-1]):
                least = None
        elif kind is op.BRANCH:
            parts = [_least_feeds(branch, secret) for branch in value[1]]
            least = None if None in parts else sum(parts)
        elif kind in (op.ASSERT, op.ASSERT_NOT):
            least = None if value[1].getwidth()[1] > 1 and _has_feeds(value[1]) else 0
        else:
            least = None
        if least is None:
            return None
        total += least
    return total


def _has_feeds(items: parser.SubPattern) -> bool:
    """Some part may match a line feed; True for what is not known."""
    for kind, value in items:
        if kind in _CHARACTERS:
            found = _takes_feed(kind, value)
        elif kind in _REPEATS:
            found = _has_feeds(value[2])
        elif kind is op.SUBPATTERN:
            found = _has_feeds(value[-1])
        elif kind is op.BRANCH:
            found = any(_has_feeds(branch) for branch in value[1])
        else:
            found = kind is not op.AT
        if found:
            return True
    return False


def _ends_firm(items: parser.SubPattern, step: int) -> bool:
    """Every match begins (step 1) or ends (step -1) with a character that is no line feed."""
    for kind, value in list(items)[::step]:
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        if kind is op.SUBPATTERN and _ends_firm(value[-1], step):
            return True
        if kind is op.BRANCH and all(_ends_firm(branch, step) for branch in value[1]):
            return True
        if kind in _REPEATS and value[0] > 0 and _ends_firm(value[2], step):
            return True
        if kind in _CHARACTERS:
            return not _takes_feed(kind, value)
        if kind not in (*_REPEATS, op.SUBPATTERN, op.BRANCH) or _has_feeds([(kind, value)]):
            return False
    return False
