"""Presentation transforms of the dashboard and chat view (X10, X16, X19,
X20, X24, X25, X27, X28, X29), as column expressions.

Markdown rendering (X25) is an ordered chain of ``regexp_replace`` calls on
the HTML-escaped text.  The rules were written for a JavaScript engine,
where ``.`` stops at \\n, \\r, U+2028 and U+2029 and ``^``/``$`` under the
multi-line flag match at those same breaks; the patterns below spell those
classes out so Java gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import col_, html_escape

# ---------------------------------------------------------------------------
# Markdown rules (applied in order) as (pattern, replacement);
# replacements use $n group references.
# ---------------------------------------------------------------------------
NOT_BREAK = r"[^\n\r\x{2028}\x{2029}]"
MARKDOWN_RULES = [
    (r"```([A-Za-z0-9_]*)\n([\s\S]*?)```", "<pre><code>$2</code></pre>"),
    (r"`([^`]+)`", "<code>$1</code>"),
    (rf"\*\*({NOT_BREAK}+?)\*\*", "<strong>$1</strong>"),
    (rf"\*({NOT_BREAK}+?)\*", "<em>$1</em>"),
    (rf"(?m)^### ({NOT_BREAK}+)$", "<h3>$1</h3>"),
    (rf"(?m)^## ({NOT_BREAK}+)$", "<h2>$1</h2>"),
    (rf"(?m)^# ({NOT_BREAK}+)$", "<h1>$1</h1>"),
    (rf"(?m)^- ({NOT_BREAK}+)$", "<li>$1</li>"),
    (rf"(?m)^([0-9]+)\. ({NOT_BREAK}+)$", "<li>$2</li>"),
    (rf"((<li>{NOT_BREAK}*</li>\n?)+)", "<ul>$1</ul>"),
    (r"\n", "<br>"),
]
# ---------------------------------------------------------------------------


def _java(p: str) -> str:
    # (?d): only \n ends a line for ^ and $ (JS also breaks lines at \r,
    # U+2028 and U+2029 for the anchors; "." is spelled out as NOT_BREAK)
    return "(?d)" + p


def _line_facts(ln: Column):
    """(first <li>, start of the last </li>, has a segment, segment ends the line)."""
    first = F.instr(ln, "<li>")
    back = F.instr(F.reverse(ln), ">il/<")
    start = F.length(ln) - back - 3
    seg = F.coalesce((first > 0) & (back > 0) & (start >= first + 4), F.lit(False))
    at_end = F.coalesce(seg & (start + 4 == F.length(ln)), F.lit(False))
    return first, start, seg, at_end


def _wrap_lists(x: Column) -> Column:
    """The list-grouping rule ``((<li>.*</li>\n?)+) -> <ul>$1</ul>`` without
    regex repetition.

    Java's regex engine recurses once per repetition of a group, so a reply
    with tens of thousands of list items overflows the stack (measured:
    20,000 items fail the task).  The same result, line by line: a line
    holds a segment from its first ``<li>`` to its last ``</li>``; a segment
    continues the previous line's run when the line starts with ``<li>`` and
    the previous segment ends its line (that newline belongs to the run).
    ``<ul>`` opens before a segment that does not continue a run; ``</ul>``
    closes right after a segment that does not end its line (or ends the
    text), else at the start of the next line when that line does not
    continue the run.  Each line only needs the previous line, so the lambda
    runs over ``arrays_zip(previous, current, is_last)`` (linear).
    """
    lines = F.split(x, "\n", -1)
    n = F.size(lines)
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, n - 1))
    last = F.concat(F.array_repeat(F.lit(False), n - 1), F.array(F.lit(True)))
    # the lambda reads only its own element: an outer expression referenced
    # inside it would be re-evaluated per element (quadratic on long texts)
    triples = F.arrays_zip(prev.alias("p"), lines.alias("c"), last.alias("is_last"))

    def rewrite(e):
        ln, pl = e["c"], e["p"]
        first, start, seg, at_end = _line_facts(ln)
        _, _, seg_p, at_end_p = _line_facts(pl)
        cont = seg & (first == 1) & seg_p & at_end_p
        close_prev = seg_p & at_end_p & ~cont
        close_here = seg & (~at_end | e["is_last"])
        closed = F.when(close_here, F.concat(ln.substr(F.lit(1), start + 4), F.lit("</ul>"),
                                             ln.substr(start + 5, F.length(ln)))).otherwise(ln)
        opened = F.when(seg & ~cont, F.concat(closed.substr(F.lit(1), first - 1), F.lit("<ul>"),
                                              closed.substr(first, F.length(closed)))).otherwise(closed)
        return F.concat(F.when(close_prev, F.lit("</ul>")).otherwise(F.lit("")), opened)

    return F.array_join(F.transform(triples, rewrite), "\n")


def markdown_html(text) -> Column:
    """X24 + X25: escape, then the markdown rules in order."""
    x = html_escape(text)
    for pat, rep in MARKDOWN_RULES:
        if rep == "<ul>$1</ul>":
            x = _wrap_lists(x)  # same result without regex repetition (see above)
        else:
            x = F.regexp_replace(x, _java(pat), rep)
    return F.when(col_(text).isNull() | (col_(text) == ""), F.lit("")).otherwise(x)


def round_half_up(x) -> Column:
    """``Math.round`` (half toward +infinity)."""
    return F.floor(col_(x) + F.lit(0.5))


def percent_label(x) -> Column:
    """A number followed by ``%``."""
    return F.concat(col_(x).cast("string"), F.lit("%"))


def ms_label(x) -> Column:
    return F.concat(col_(x).cast("string"), F.lit("ms"))


def initial(name) -> Column:
    """First character, upper-cased."""
    return F.upper(F.substring(col_(name), 1, 1))


def month_day(d) -> Column:
    """``MM-dd`` of a date."""
    return F.date_format(col_(d), "MM-dd")


def age_label(ts, as_of) -> Column:
    """X19: 'just now', 'Nm ago', 'Nh ago' or 'Nd ago' relative to ``as_of``."""
    diff_ms = F.unix_millis(col_(as_of).cast("timestamp")) - F.unix_millis(col_(ts).cast("timestamp"))
    mins = F.floor(diff_ms / 60000)
    hrs = F.floor(mins / 60)
    return (F.when(col_(ts).isNull(), F.lit(""))
            .when(mins < 1, F.lit("just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hrs < 24, F.concat(hrs.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(hrs / 24).cast("string"), F.lit("d ago"))))


def iso_text(ts) -> Column:
    """ISO-8601 text with microseconds."""
    return F.date_format(col_(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def shift_hours(ts, hours: int) -> Column:
    """A timestamp moved by a whole number of hours."""
    return col_(ts) + F.make_dt_interval(hours=F.lit(hours))


def pseudonym(c, salt: str = "user:") -> Column:
    """SHA-256 hex of a salted key (stable pseudonymous id)."""
    return F.sha2(F.concat(F.lit(salt), col_(c).cast("string")), 256)
