"""Text column builders (X1-X9, X21-X24 and the regex/keyword primitives).

Everything returns a :class:`Column` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen; nothing here is a Python UDF.

Regex dialect
-------------
Rules are written in Python ``re`` syntax and applied to lower-cased,
stripped text.  :func:`java_regex` rewrites what Java reads differently:

* ``\\b`` and ``\\B`` -> look-arounds on ``[\\p{L}\\p{N}_]`` (a Python word
  character is any Unicode letter or number, or ``_``); ``\\b`` is one-sided
  where the neighbour is surely a word character;
* ``\\w \\W \\s \\S \\d \\D`` -> Python's sets spelled out;
* ``.`` stops only at ``\\n`` -> flag ``(?d)``.

A rule ``A.*B`` would scan the rest of the line again from every ``A``.  If the
first ``A`` of a line has no ``B`` after it, no later one has, so
:func:`search_regex` tries only the first ``A`` that starts and ends on a line
(and those that run over a line end): linear in the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD_CLASS = r"\p{L}\p{N}_"
WORD = f"[{_WORD_CLASS}]"
_BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_NO_BOUNDARY = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
_BEFORE_WORD = rf"(?<!{WORD})"
_AFTER_WORD = rf"(?!{WORD})"
# Python's whitespace set: \t-\r, \x1c-\x1f, space, \x85 and the Unicode
# separators (Zs, Zl, Zp)
_WS_CLASS = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"
_WS_SAME_LINE = r"[\t\x{0b}-\r\x{1c}-\x{1f} \x{85}\p{Z}]"
_ESCAPES = {  # outside a class, inside a class
    "s": (f"[{_WS_CLASS}]", _WS_CLASS), "S": (f"[^{_WS_CLASS}]", f"[^{_WS_CLASS}]"),
    "d": (r"\p{Nd}", r"\p{Nd}"), "D": (r"\P{Nd}", r"\P{Nd}"),
    "w": (WORD, _WORD_CLASS), "W": (f"[^{_WORD_CLASS}]", f"[^{_WORD_CLASS}]"),
}
_META = set("\\()[].*+?{}|^$")


def _tokens(pattern: str) -> list[tuple[str, bool]]:
    """(token, inside a class) - a token is a character or an escape."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        n = 2 if pattern[i] == "\\" else 1
        tok = pattern[i:i + n]
        if tok == "]" and in_class:
            in_class = False
        out.append((tok, in_class))
        if tok == "[" and not in_class:
            in_class = True
        i += n
    return out


def _top_level(pattern: str, sep: str) -> list[str]:
    """``pattern`` cut at ``sep`` (a token, or ``.*``) outside groups and classes."""
    parts, depth, cur = [], 0, ""
    toks = _tokens(pattern)
    i = 0
    while i < len(toks):
        tok, in_class = toks[i]
        if not in_class:
            depth += (tok == "(") - (tok == ")")
            here = tok if len(sep) == 1 else tok + (toks[i + 1][0] if i + 1 < len(toks) else "")
            if depth == 0 and here == sep:
                parts.append(cur)
                cur = ""
                i += len(sep)
                continue
        cur += tok
        i += 1
    return parts + [cur]


def _group_end(pattern: str) -> int:
    """Index after the group that ``pattern`` starts with."""
    depth = at = 0
    for tok, in_class in _tokens(pattern):
        at += len(tok)
        if not in_class:
            depth += (tok == "(") - (tok == ")")
            if depth == 0:
                break
    return at


def anchors(pattern: str) -> list[str] | None:
    """Literal texts one of which every match of ``pattern`` starts with.

    Taken from the leading literals of every alternative, into leading groups;
    ``None`` where an alternative has none (then the rule is always run).
    """
    out: list[str] = []
    for alt in _top_level(pattern, "|"):
        p = alt
        while p.startswith(r"\b"):
            p = p[2:]
        if p.startswith("("):
            end = _group_end(p)
            body = p[1:end - 1].removeprefix("?:")
            found = None if body.startswith("?") or p[end:end + 1] in ("?", "*", "{") else anchors(body)
        else:
            k = 0
            while k < len(p) and p[k] not in _META:
                k += 1
            if p[k:k + 1] in ("*", "?", "{"):
                k -= 1  # the last character is optional
            found = [p[:k]] if k > 0 else None
        if not found:
            return None
        out += found
    return out


def _starts_in_word(rest: str) -> bool:
    found = anchors(rest) if rest[:1] not in ("", "\\") else None
    return bool(found) and len(_top_level(rest, "|")) == 1 and all(a[0].isalnum() for a in found)


def _ends_in_word(head: str) -> bool:
    """Every match of ``head`` ends in a word character (when in doubt: no)."""
    toks = _tokens(head)
    if not toks:
        return False
    last = toks[-1][0]
    if last != ")":
        return last.isalnum() and not toks[-1][1]
    depth, at = 0, len(head)
    for tok, in_class in reversed(toks):
        at -= len(tok)
        if not in_class:
            depth += (tok == ")") - (tok == "(")
            if depth == 0:
                break
    body = head[at + 1:-1].removeprefix("?:")
    return not body.startswith("?") and all(_ends_in_word(x) for x in _top_level(body, "|"))


def _java_body(pattern: str, ws: str | None = None) -> str:
    """The rule in Java syntax, groups not capturing; ``ws`` replaces ``\\s``."""
    out, at = [], 0
    toks = _tokens(pattern)
    for i, (tok, in_class) in enumerate(toks):
        at += len(tok)
        if tok == r"\b" and not in_class:
            rest, head = pattern[at:], pattern[:at - 2]
            out.append(_BEFORE_WORD if _starts_in_word(rest) else _AFTER_WORD if _ends_in_word(head) else _BOUNDARY)
        elif tok == r"\B" and not in_class:
            out.append(_NO_BOUNDARY)
        elif tok == r"\s" and not in_class and ws is not None:
            out.append(ws)
        elif len(tok) == 2 and tok[1] in _ESCAPES:
            out.append(_ESCAPES[tok[1]][in_class])
        elif tok == "(" and not in_class and (i + 1 == len(toks) or toks[i + 1][0] != "?"):
            out.append("(?:")
        else:
            out.append(tok)
    return "".join(out)


def java_regex(pattern: str) -> str:
    """Python-``re`` rule -> equivalent Java regex (see module doc)."""
    return "(?d)" + _java_body(pattern)


def _over_line_end(head: str) -> list[str]:
    """``head`` with a line end in one of its ``\\s`` runs, one form per run.

    A run inside a group stands for its own alternative only.
    """
    out, at = [], 0
    toks = _tokens(head)
    start = bar = None  # of the group and of the alternative we are in
    for i, (tok, in_class) in enumerate(toks):
        at += len(tok)
        if in_class:
            continue
        if tok == "(":
            start = bar = at
        elif tok == "|":
            bar = at
        elif tok == ")":
            start = None
        elif tok == r"\s":
            q = toks[i + 1][0] if i + 1 < len(toks) and toks[i + 1][0] in ("*", "+") else ""
            before, after = head[:at - 2], head[at + len(q):]
            if start is not None:
                inside = _group_end("(" + head[start:]) - 1 + start  # after its )
                before = head[:start] + head[bar:at - 2]
                rest = head[at + len(q):inside - 1]
                after = _top_level(rest, "|")[0] + head[inside - 1:]
            some = r"\s*" if q else ""
            out.append(_java_body(before + some + r"\n" + some + after))
    return out


def search_regex(pattern: str) -> tuple[str, int]:
    """(Java regex, number of groups): the match is the group that is found,
    or all of it for 0 groups."""
    parts = _top_level(pattern, ".*") if len(_top_level(pattern, "|")) == 1 else [pattern]
    if len(parts) == 2 and all(parts):
        head, tail = parts
        # only \s may run over a line end in the first part
        plain = not any(tok in (r"\n", r"\S", r"\W", r"\D", ".", "[") for tok, _ in _tokens(head)) and "(?" not in head
        if plain and _space_is_simple(head) and ".*" not in tail:
            b = _java_body(tail)
            first = _java_body(head, _WS_SAME_LINE)
            forms = [f"(?m:^)(?>.*?(?={first}))({first}.*{b})"] + [f"({h}.*{b})" for h in _over_line_end(head)]
            return "(?d)" + "|".join(forms), len(forms)
    return java_regex(pattern), 0


def _space_is_simple(head: str) -> bool:
    """Every ``\\s`` is at the top or in a group that is there exactly once."""
    depth, at, spaced = 0, 0, 0
    for tok, in_class in _tokens(head):
        at += len(tok)
        if not in_class:
            depth += (tok == "(") - (tok == ")")
            if tok == r"\s":
                spaced = max(spaced, depth)
            if tok == ")":
                if spaced > 1 or spaced == 1 and head[at:at + 1] in ("?", "*", "+", "{"):
                    return False
                spaced = 0
    return True


def col_(c) -> Column:
    """A column from a name or a Column."""
    return F.col(c) if isinstance(c, str) else c


# -- X1, X2: case and whitespace --------------------------------------------

# the same set as characters, for btrim
WHITESPACE = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680,
                                      *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``trim`` only removes ASCII spaces; ``btrim`` with the full whitespace
    set is exact (and cheaper than an anchored regex).
    """
    return F.btrim(col_(c), F.lit(WHITESPACE))


def norm(c) -> Column:
    """lower-case then strip, the form every input rule is matched on."""
    return strip_ws(F.lower(col_(c)))


# -- X3: regex search with first-match-wins ----------------------------------

def _gate(c, pattern: str) -> Column | None:
    words = anchors(pattern)
    return None if words is None else contains_any(c, sorted(set(words)))


def rlike_any(c, patterns: Sequence[str]) -> Column:
    """True when any rule matches.

    A rule runs only when one of its leading literals occurs (cheap
    ``contains`` tests); rules without such literals always run.
    """
    c = col_(c)
    terms = []
    for p in patterns:
        gate, hit = _gate(c, p), c.rlike(search_regex(p)[0])
        terms.append(hit if gate is None else gate & hit)
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def _extract(c: Column, pattern: str) -> Column:
    regex, groups = search_regex(pattern)
    found = [F.nullif(F.regexp_extract(c, regex, g), F.lit("")) for g in (range(1, groups + 1) if groups else [0])]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def first_match(c, patterns: Sequence[str]) -> Column:
    """Matched text of the first rule (in list order) that matches, else NULL.

    Each rule is tried only when its leading literals occur (cheap
    ``contains``); ``coalesce`` evaluates the rules lazily in order, and no
    rule matches the empty string, so '' means no match.
    """
    c = col_(c)
    found = []
    for p in patterns:
        gate = _gate(c, p)
        found.append(_extract(c, p) if gate is None else F.when(gate, _extract(c, p)))
    return F.coalesce(*found) if len(found) > 1 else found[0]


# -- X4, A14-A16: keyword containment and scores ----------------------------

def contains_any(c, words: Iterable[str]) -> Column:
    """True when the text contains any of ``words`` (substring)."""
    c = col_(c)
    out = None
    for w in words:
        e = c.contains(w)
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def keyword_score(c, keywords: Iterable[str], weight) -> Column:
    """Sum of ``weight(kw)`` over keywords contained in ``c`` (substring)."""
    c = col_(c)
    terms = [F.when(c.contains(k), F.lit(int(weight(k)))).otherwise(F.lit(0)) for k in keywords]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def intent_weight(kw: str) -> int:
    """+1 per keyword, +1 more when it has more than one word."""
    return 2 if len(kw.split()) > 1 else 1


def argmax_label(scored: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(label, score) of the highest score; ties go to the earlier label."""
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(lbl).alias("l"))
                        for i, (lbl, s) in enumerate(scored)])
    return best["l"], best["s"]


# -- X5, X9, X21-X24 ---------------------------------------------------------

def left(c, n: int) -> Column:
    """First ``n`` characters (code points, like Python slicing)."""
    return F.substring(col_(c), 1, n)


def query_cleanup(c, steps: Sequence[str]) -> Column:
    """Lower, then for each step remove it and strip; original if empty."""
    x = F.lower(col_(c))
    for s in steps:
        x = strip_ws(F.replace(x, F.lit(s), F.lit("")))
    return F.when(F.length(x) > 0, x).otherwise(col_(c))


def html_escape(c) -> Column:
    """Escape ``&`` first, then ``<`` and ``>``."""
    x = F.replace(col_(c), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    return F.replace(x, F.lit(">"), F.lit("&gt;"))


def short_id(*cols) -> Column:
    """Deterministic 8-hex-char request id from the row key."""
    return F.substring(F.sha2(F.concat_ws("|", *[col_(c).cast("string") for c in cols]), 256), 1, 8)


def model_label_clean(c) -> Column:
    """Lower-case, keep only a-z."""
    return F.regexp_replace(F.lower(col_(c)), "[^a-z]", "")
