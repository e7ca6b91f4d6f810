r"""JavaScript as text that patterns can't misread.

Strings, templates, comments and regular expressions nest (a template's fill-in may hold templates), which no regular expression can follow, so
one small scanner with a stack marks them; all rules are built-in expressions over its result:

* A string is \x01 content \x02. In its content all but letters, digits and _ are other characters, so no pattern for code matches there. Of long strings
  only what a rule could look for is kept.
* A template is such a string, with the code that it fills in behind it, whatever its depth.
* Comments are a space, regular expressions a word.
* A parenthesis has its depth beside it, as a character of the private range: ( d before, d ) after. One call's arguments end at the first ) of its depth.
* \x0e stands at the end if something doesn't close.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "\x0e"
DEPTHS = 6000
#: Of a string of more characters only its first word and those with a slash or a point are kept: no rule looks for other words in strings so long.
LONG = 256
_FOREIGN = re.compile("[\x01-\x08\x0e\ue000-\uf8ff]")
_PART = re.compile(r"""(?P<text>"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*')|(?P<note>//[^\n]*|/\*[\s\S]*?\*/)|(?P<plain>[^"'`(){}/]+)|(?P<mark>[\s\S])""")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,5})\}|\r?\n|([\s\S]))")
_WORD = re.compile(r"[\w$]+$")
#: After these a value follows, so a slash opens a regular expression; after ) of these a statement does.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"}
_HEADS = {"if", "while", "for", "with"}
_INSIDE = {k: "\x07" for k in range(128) if not (chr(k).isalnum() or chr(k) == "_")} | {ord("."): "\x04", ord("/"): "\x05", ord(":"): "\x06"}


def _string(content: str) -> str:
    if "\\" in content:
        content = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else {"n": "\n", "t": "\t"}.get(m[4], m[4] or ""), content)
    if len(content) > LONG:
        words = content.split()
        kept = [w for w in words[1:] if "/" in w or "." in w]
        content = content[:1] * content[:1].isspace() + " ".join([*words[:1], *kept])
    return "\x01" + _FOREIGN.sub(" ", content).translate(_INSIDE) + "\x02"


def scan(source: str) -> str:
    """The text that the module describes, of one source; linear in its length."""
    if source.startswith("#!"):
        source = source.partition("\n")[2]
    out: list[str] = []
    outer: list[tuple] = []  # templates that are being filled in: text so far, fill-ins so far, code around, braces around
    heads: list[bool] = []  # of each open parenthesis, whether a statement follows it
    braces, pos, broken, tail, after_head = 0, 0, False, "", False

    def template(text: list[str], filled: list[str], around: list[str], held: int, start: int) -> None:
        """Read on in a template until it ends or is filled in."""
        nonlocal out, pos, braces, broken, tail
        part = _TEMPLATE.match(source, start)
        text.append(part[0])
        pos = part.end()
        if source.startswith("${", pos):
            outer.append((text, filled, around, held))
            out, braces, pos, tail = [], 0, pos + 2, "("
            return
        broken |= pos >= len(source)
        pos += 1
        around.append(_string("".join(text)) + "".join(";" + code for code in filled))
        out, braces, tail = around, held, "\x02"

    while pos < len(source):
        part = _PART.match(source, pos)
        kind, value, start, pos = part.lastgroup, part[0], pos, part.end()
        if kind == "plain":
            out.append(_FOREIGN.sub(" ", value))
            tail = value.rstrip()[-20:] or tail
        elif kind == "text":
            out.append(_string(value[1:-1]))
            tail = "\x02"
        elif kind == "note":
            out.append(" ")
        elif value == "`":
            template([], [], out, braces, pos)
        elif value == "}" and outer and braces == 0:
            text, filled, around, held = outer.pop()
            filled.append("".join(out))
            template(text, filled, around, held, pos)
        elif value == "(":
            word = _WORD.search(tail)
            out.append("(" + chr(0xE000 + len(heads) % DEPTHS))
            heads.append(bool(word) and word[0] in _HEADS)
            tail = value
        elif value == ")":
            after_head = heads.pop() if heads else False
            out.append(chr(0xE000 + len(heads) % DEPTHS) + ")")
            tail = value
        elif value == "/":
            word = _WORD.search(tail)
            opens = word[0] in _BEFORE_VALUE if word else after_head if tail == ")" else not tail.endswith(("]", "\x02"))
            literal = _REGEX.match(source, start) if opens else None
            if source.startswith("/*", start):
                broken, pos = True, len(source)
            elif literal:
                out.append(" r ")
                pos, tail = literal.end(), "]"
            else:
                out.append("/")
                tail = "/"
        elif value in "{}":
            braces += 1 if value == "{" else -1
            out.append(value)
            tail = value
        else:  # a quote that nothing closes
            broken = True
    while outer:
        text, filled, around, _ = outer.pop()
        around.append(_string("".join(text)) + "".join(";" + code for code in [*filled, "".join(out)]))
        out, broken = around, True
    return "".join(out) + (BROKEN if broken else "")


@F.pandas_udf(T.StringType())
def _scanned(source: pd.Series) -> pd.Series:
    return source.map(scan)


def scanned(source: Column) -> Column:
    """The text of scan(); null counts as empty."""
    return _scanned(F.coalesce(source, F.lit("")))
