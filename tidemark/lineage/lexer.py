"""SQL tokens with their character spans, for all supported dialects at once."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|\#(?![>\-\w])[^\n]*|/\*.*?\*/)
      |(?P<string>(?:[bBnNrRxXeE]|[uU]&)?'(?:[^'\\]|''|\\.)*')
      |(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
      |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[A-Za-z_][^\]\n,\[]*\])
      |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
      |(?P<param>\$\d+|:[A-Za-z_]\w*|@@?\w+|\?)
      |(?P<word>[^\W\d][\w$]*)
      |(?P<op>::|->>|->|\#>>|\#>|<=>|<>|!=|>=|<=|\|\||=>|:=|~\*|!~\*|!~|@>|<@|&&|<<|>>|[-+*/%^&|~<>=(),.;:\[\]{}@!?])""",
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


class SqlError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


def tokens(sql: str, brackets: bool = False) -> list[Token]:
    """All tokens but white space and comments. [x] is a quoted name only where brackets is set."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r}", at)
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        if kind == "quoted" and m[0][0] == "[" and not brackets:
            out.append(Token("op", "[", at, at + 1))
            at += 1
            continue
        if kind != "space":
            out.append(Token("string" if kind == "dollar" else kind, m[0], at, m.end()))
        at = m.end()
    return out


#: Words after END that close what no BEGIN or CASE opened (fixed values).
_CLOSED = {"IF", "LOOP", "WHILE", "FOR", "REPEAT"}
_ROUTINES = {"PROCEDURE", "FUNCTION", "TRIGGER", "TASK", "EVENT", "PACKAGE"}


def _split(toks: list[Token], blocks: bool) -> list[tuple[int, int]] | None:
    """Spans of statements. With blocks, a semicolon between BEGIN and END of a routine parts nothing; None if one stays open."""
    out: list[tuple[int, int]] = []
    first, last, depth, head = None, 0, 0, []
    for i, t in enumerate(toks):
        if t.text == ";" and t.kind == "op" and not depth:
            if first is not None:
                out.append((first, last))
            first, head = None, []
            continue
        if t.kind == "word":
            head = [*head, t.upper] if len(head) < 6 else head
            if blocks and head[0] == "CREATE" and _ROUTINES & set(head):
                after = toks[i + 1].upper if i + 1 < len(toks) else ""
                before = toks[i - 1].upper if i else ""
                if t.upper == "BEGIN" or t.upper == "CASE" and before != "END":
                    depth += 1
                elif t.upper == "END" and after not in _CLOSED:
                    depth = max(0, depth - 1)
        first = t.start if first is None else first
        last = t.end
    if depth:
        return None
    return [*out, (first, last)] if first is not None else out


def statements(sql: str, brackets: bool = False) -> list[tuple[int, int]]:
    """Character spans of the statements that semicolons part, without empty ones.

    The text is taken as a whole first, so that the bodies of procedures, functions and triggers stay with them; where
    that leaves a block open, semicolons alone count, and where the text has no tokens, plain splitting.
    """
    try:
        toks = tokens(sql, brackets)
        whole = _split(toks, True)
        return whole if whole is not None else _split(toks, False) or []
    except SqlError:
        out, at = [], 0
        for part in sql.split(";"):
            lead = len(part) - len(part.lstrip())
            if part.strip():
                out.append((at + lead, at + len(part.rstrip())))
            at += len(part) + 1
        return out


def utf16_offset(sql: str, at: int) -> int:
    """A character offset as editors and browsers count it: in UTF-16 units."""
    return len(sql[:at].encode("utf-16-le")) // 2
