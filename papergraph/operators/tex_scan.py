"""Plain scanners of one LaTeX source: mathematics, notation, definitions, environments.

Each walks the text once, by marks and braces; what they find goes by the paper's own row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

_BRACE = re.compile(r"(?<!\\)[{}]")
_COMMAND = re.compile(r"\\([a-zA-Z]+)")
_TURN = re.compile(r"\\(begin|end)\{([^{}]+)\}")
_OPENS = re.compile(r"\$\$?|\\[\[(]|\\begin\{")
_BASE = re.compile(r"[a-zA-Z\\]")
_IN_SCRIPT = re.compile(r"[a-zA-Z0-9\\]{1,12}")


def brace_pairs(text: str) -> dict[int, int]:
    """The place of each opening brace that is closed, and where; escaped braces don't count."""
    pairs: dict[int, int] = {}
    waiting: list[int] = []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            waiting.append(m.start())
        elif waiting:
            pairs[waiting.pop()] = m.start()
    return pairs


def past(text: str, at: int, what: str) -> int:
    """Where the text goes on behind ``what``, if that stands at ``at``."""
    return at + len(what) if text.startswith(what, at) else at


def past_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def past_option(text: str, at: int) -> tuple[int, str | None]:
    """Behind a group in square brackets at ``at``, and what it holds."""
    end = text.find("]", at) if text.startswith("[", at) else -1
    return (at, None) if end < 0 else (end + 1, text[at + 1 : end])


class Regions:
    """Mathematics of a source: between dollars, in brackets and in display environments.

    A mark that nothing closes is passed over; that a kind of mark is closed no more is
    noted, so that no text is searched twice.
    """

    CLOSES = {"$$": "$$", "$": "$", r"\[": r"\]", r"\(": r"\)"}

    def __init__(self, text: str, displays: tuple[str, ...]):
        self.text, self.displays, self.open = text, displays, set()
        self.ends = [m.span() for m in _TURN.finditer(text) if m[1] == "end" and self._is_display(m[2])]

    def _is_display(self, name: str) -> bool:
        return name.removesuffix("*") in self.displays

    def _closed(self, mark: str, at: int) -> tuple[int, int, int] | None:
        """Start and end of what ``mark`` at ``at`` opens, and where the text goes on."""
        if mark == r"\begin{":
            m = _TURN.match(self.text, at)
            k = bisect_left(self.ends, (m.end(), 0)) if m and self._is_display(m[2]) else len(self.ends)
            return (m.end(), *self.ends[k]) if k < len(self.ends) else None
        if mark in self.open:
            return None
        start = at + len(mark)
        end = self.text.find(self.CLOSES[mark], start + mark.startswith("$"))  # nothing at all between dollars is no mathematics
        if end < 0:
            self.open.add(mark)
            return None
        return start, end, end + len(self.CLOSES[mark])

    def __iter__(self):
        at = 0
        while m := _OPENS.search(self.text, at):
            marks = ("$$", "$") if m[0] == "$$" else (m[0],)
            found = next(filter(None, (self._closed(mark, m.start()) for mark in marks)), None)
            if found:
                yield self.text[found[0] : found[1]]
            at = found[2] if found else m.start() + 1


def _script_end(text: str, at: int, mark: str) -> int:
    """Behind a script that ``mark`` opens at ``at``; ``at`` itself if none does."""
    if not text.startswith(mark, at):
        return at
    m = _IN_SCRIPT.match(text, past(text, at + 1, "{"))
    return past(text, m.end(), "}") if m else at


def notation(region: str, greek: tuple[str, ...]):
    """Letters and Greek names in order, each with its subscript and then its superscript."""
    at = 0
    while m := _BASE.search(region, at):
        at = m.start()
        name = m[0] if m[0] != "\\" else next((g for g in greek if region.startswith(g, at + 1)), "")
        end = at + len(name) + (m[0] == "\\")
        if name:
            for mark in "_^":
                end = _script_end(region, end, mark)
            yield region[at:end]
        at = end


def commonest_notation(text: str, displays: tuple[str, ...], greek: tuple[str, ...], ignored: tuple[str, ...], least: int, most: int) -> list[tuple[str, int]]:
    """Tokens without braces and their counts, the commonest first, ties by first sight. A bare
    lower-case letter is no notation."""
    counts: Counter[str] = Counter()
    for region in Regions(text, displays):
        for token in notation(region, greek):
            bare = token.replace("{", "").replace("}", "")
            if (len(bare) > 1 or bare.isupper()) and bare not in ignored:
                counts[bare] += 1
    return [(t, n) for t, n in counts.most_common(most) if n >= least]  # equal counts come in the order of first sight


def definitions(text: str, commands: tuple[str, ...], most: int = 2000) -> list[tuple[str, str]]:
    r"""(name, body) of macros that one of ``commands`` defines: ``\new{\name}[n]{body}``, with or
    without the braces, the star and the number; bodies of fewer than ``most`` characters."""
    out: list[tuple[str, str]] = []
    starts = [m.end() for m in _COMMAND.finditer(text) if m[1] in commands]
    pairs = brace_pairs(text) if starts else {}
    for at in starts:
        name = _COMMAND.match(text, past(text, past_blanks(text, past(text, at, "*")), "{"))
        if not name:
            continue
        at = past_blanks(text, past(text, name.end(), "}"))
        behind, number = past_option(text, at)
        if number is not None and number.isdigit():
            at = past_blanks(text, behind)
        end = pairs.get(at)
        if end is not None and end - at < most:
            out.append((name[1], text[at + 1 : end]))
    return out


def declared(text: str, kinds: tuple[str, ...]) -> dict[str, tuple[int, str]]:
    r"""Environments by name: their rank and kind. The ``kinds`` themselves come first, then
    what ``\newtheorem`` declares under a display name that has a kind in it."""
    out = {k: (n, k) for n, k in enumerate(kinds)}
    nth = 0
    for m in _COMMAND.finditer(text):
        if m[1] != "newtheorem":
            continue
        at = past(text, m.end(), "*")
        end = text.find("}", at) if text.startswith("{", at) else -1
        if end <= at + 1:
            continue
        env = text[at + 1 : end].strip()
        at = past_option(text, end + 1)[0]
        end = text.find("}", at) if text.startswith("{", at) else -1
        if end <= at + 1:
            continue
        shown = text[at + 1 : end].strip().lower()
        kind = next((k for k in kinds if k in shown), None)
        if kind:
            out[env] = (len(kinds) + nth, kind)
        nth += 1
    return out


def statements(text: str, kinds: tuple[str, ...]) -> list[tuple[str, str, str, int]]:
    """(kind, title, body, depth) of theorem-like environments, by rank and then place.

    One pass over the turns: of each name the first opening waits for the first end; depth is
    how many other theorem-like environments are open where it starts.
    """
    known = declared(text, kinds)
    waiting: dict[str, tuple[int, int, str]] = {}
    found: dict[tuple[int, int], tuple[str, str, str, int]] = defaultdict(tuple)
    for m in _TURN.finditer(text):
        env = m[2]
        if env not in known:
            continue
        if m[1] == "begin" and env not in waiting:
            start, title = past_option(text, m.end())
            waiting[env] = (start, len(waiting), title or "")
        elif m[1] == "end" and env in waiting and m.start() >= waiting[env][0]:
            start, depth, title = waiting.pop(env)
            rank, kind = known[env]
            found[rank, start] = (kind, title, text[start : m.start()], depth)
    return [found[k] for k in sorted(found)]
