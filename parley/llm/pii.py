"""Format-preserving Feistel pseudonyms for personal data (native).

Candidates are found by one pattern, validated (issuer, length and Luhn digits of cards, octets
of addresses, days of dates, ranges of social security numbers) and replaced
by a keyed permutation within their own format, so equal values have equal
pseudonyms in every document, however cards, phones and dates are written, and
only the key leads back.  (A card is permuted once more where its pseudonym and
the digits beside it would make another card, see ``_run``.)

Two Feistel networks are used, both of ``ROUNDS`` rounds with a SHA-2 round
function of key, kind, round and the other half:

* over text: one half's characters are shifted within their class (digits,
  lower case, upper case) - phones, card bodies, e-mail names, secrets;
* over numbers: ``l += f(r) mod a``, ``r += f(l) mod b`` - addresses
  (2^16 x 2^16), dates (from 1900 to 2099, 160 x 180 with a day up to 12 and
  177 x 250 - 1 with a day over 12) and social security numbers (898 x 989901).

The text is cut at the matches and joined again in the row: no shuffle, no
Python.  Texts without a digit or ``@`` are not searched at all.

Defined results: ``pii_*`` columns replace columns of the same name; null text stays null; values that fail their validation stay
as they are; a text of any length is searched to its end; repeated rows and
equal values get equal results; all other columns are kept; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# Patterns of candidates.  Quantifiers are bounded, so the search is linear.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,6}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|\b(?:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9]{8,128}(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|-[0-9])"
# Cards are looked for in whole runs of digit groups that one blank or hyphen
# parts; a run ends where one of the other values begins.
_SEP = rf"(?:-| (?!{IP}|{DATE}|{SSN}|{PHONE}))(?![0-9]{{20}}|[0-9]{{1,19}}[A-Za-z])"
CARD = rf"(?<![0-9A-Za-z])(?=[0-9](?:(?:{_SEP})?[0-9]){{12}})[0-9]{{1,19}}+(?![0-9A-Za-z])(?:{_SEP}[0-9]{{1,19}}+)*+"
PATTERN = "|".join((EMAIL, SECRET, IP, DATE, SSN, PHONE, CARD))


def _f(key: str, kind: str, i: Column, half: Column) -> Column:
    """The round function: 128 hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 512)


def _number(hexed: Column) -> Column:
    return F.conv(F.substr(hexed, F.lit(1), F.lit(12)), 16, 10).cast("long")


def _rounds(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel_numbers(l: Column, r: Column, a: int, b: int, key: str, kind: str, undo: bool) -> Column:
    """A keyed permutation of pairs below (a, b), as struct(l, r)."""
    sign = F.lit(-1 if undo else 1)

    def step(x, i):
        left = F.pmod(x["l"] + sign * F.pmod(_number(_f(key, kind, i, x["r"])), F.lit(a)), F.lit(a))
        right = F.pmod(x["r"] + sign * F.pmod(_number(_f(key, kind, i, x["l"])), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise(right).alias("r"))

    return F.aggregate(_rounds(undo), F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), step)


def _shift(half: Column, hexed: Column, sign: int) -> Column:
    """``half`` with each character moved within its class."""

    def one(i):
        c = F.substr(half, i, F.lit(1))
        n = F.conv(F.substr(hexed, F.pmod(i - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int") * sign
        moved = lambda first, size: F.char(F.pmod(F.ascii(c) - first + n, F.lit(size)) + first)
        return F.when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).otherwise(c)

    return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), "")).otherwise(half)


def feistel_text(s: Column, key: str, kind: str, undo: bool) -> Column:
    """A keyed permutation of the strings with the same character classes."""
    cut = F.floor(F.length(s) / 2).cast("int")
    sign = -1 if undo else 1

    def step(x, i):
        even = i % 2 == 0
        moved = _shift(F.when(even, x["l"]).otherwise(x["r"]), _f(key, kind, i, F.when(even, x["r"]).otherwise(x["l"])), sign)
        return F.struct(F.when(even, moved).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise(moved).alias("r"))

    start = F.struct(F.substr(s, F.lit(1), cut).alias("l"), F.substr(s, cut + 1, F.length(s)).alias("r"))
    return F.aggregate(_rounds(undo), start, step, lambda x: F.concat(x["l"], x["r"]))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digit_at(digits: Column, i: Column) -> Column:
    return F.substr(digits, i, F.lit(1)).cast("int")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum; ``double_last``: the check digit is not there yet."""

    def add(total, i):
        d = _digit_at(digits, i)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        from_end = F.length(digits) - i
        return total + F.when(from_end % 2 == (0 if double_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _with_digits(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by ``digits`` in turn."""

    def one(i):
        place = F.length(_bare(F.substr(m, F.lit(1), i)))
        c = F.substr(m, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")


#: The leading digits of card issuers and the lengths of their numbers
ISSUERS = (
    (("4",), (13, 16, 19)),
    (("34", "37"), (15,)),
    (("30", "36", "38", "39"), (14,)),
    (("22", "23", "24", "25", "26", "27", "51", "52", "53", "54", "55"), (16,)),
    (("35",), (16, 17, 18, 19)),
    (("50", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "67", "68", "69"), (13, 14, 15, 16, 17, 18, 19)),
)


def _issued(digits: Column) -> Column:
    """Leading digits of an issuer and one of its lengths."""
    out, n = F.lit(False), F.length(digits)
    for heads, lengths in ISSUERS:
        out = out | (F.substr(digits, F.lit(1), F.lit(len(heads[0]))).isin(*heads) & n.isin(*lengths))
    return out


def _is_card(digits: Column) -> Column:
    return F.when(_issued(digits), luhn_sum(digits, False) % 10 == 0).otherwise(F.lit(False))


def _card(m: Column, key: str, undo: bool) -> Column:
    """The issuer's digits and separators stay, the body's bare digits are
    permuted, the check digit is made anew."""

    def other(digits):
        head = F.when(digits.startswith("4"), 1).otherwise(2)
        body = F.concat(F.substr(digits, F.lit(1), head), feistel_text(F.substr(digits, head + 1, F.length(digits) - head - 1), key, "card", undo))
        checked = lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))
        return F.when(_is_card(digits), _let(_let(body, checked), lambda new: _with_digits(m, new))).otherwise(m)

    return _let(_bare(m), other)


def _phone(m: Column, key: str, undo: bool) -> Column:
    """The country code and separators stay, the ten bare digits are permuted."""
    head = F.regexp_extract(m, r"^(?:\+1[ .-]?)?", 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    new = _let(_bare(rest), lambda digits: feistel_text(digits, key, "phone", undo))
    return F.concat(head, _let(new, lambda digits: _with_digits(rest, digits)))


#: cards as they are usually written: one group, groups of four, 4-6-5 or 4-6-4
LAYOUT = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
MOST_GROUPS, WALK = 19, 200
#: a card's digits decide on windows that begin at most twice 18 groups before it
REACH = 40


def _groups(run: Column) -> Column:
    """The digit groups of a run, each with the separator behind it."""
    return F.split(run, "(?<=[ -])")


def _window(groups: Column, at: Column, n: Column) -> Column:
    return F.rtrim(F.array_join(F.slice(groups, at, n), ""), F.lit(" -"))


def _valid_at(groups: Column, at: Column) -> Column:
    """The cards that can begin at the group ``at``: array of (n, usual), how
    many groups they have and whether these are a usual layout."""
    none = F.struct(F.lit("").alias("digits"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("found"))

    def step(x, g):
        def longer(d):
            n = x["n"] + 1
            found = F.when(_is_card(d), F.concat(x["found"], F.array(n))).otherwise(x["found"])
            return F.struct(d.alias("digits"), n.alias("n"), found.alias("found"))
        return F.when(F.length(x["digits"]) >= 19, x).otherwise(_let(F.concat(x["digits"], F.rtrim(g, F.lit(" -"))), longer))

    lengths = F.aggregate(F.slice(groups, at, MOST_GROUPS), none, step, lambda x: x["found"])
    usual = lambda n: F.struct(n.alias("n"), _window(groups, at, n).rlike(LAYOUT).alias("usual"))
    empty = F.array().cast("array<struct<n:int,usual:boolean>>")
    return F.when(F.element_at(groups, at).rlike("^[2-6]"), F.transform(lengths, usual)).otherwise(empty)


def _cards(groups: Column, last: Column) -> Column:
    """(at, n) of the cards that begin at the groups 1 to ``last``, none over
    another: from left to right the shortest usual layout, else the longest that
    no card of a usual layout overlaps.  Each group's windows are judged once."""

    def scan(valid):
        usual = lambda i: F.exists(F.get(valid, i - 1), lambda v: v["usual"])
        overlapped = lambda at, n: F.when(n > 1, F.exists(F.sequence(at + 1, F.greatest(at + n - 1, at + 1)), usual)).otherwise(F.lit(False))

        def best(at):
            here = F.get(valid, at - 1)
            short = F.array_min(F.transform(F.filter(here, lambda v: v["usual"]), lambda v: v["n"]))
            plain = F.array_max(F.transform(F.filter(here, lambda v: ~overlapped(at, v["n"])), lambda v: v["n"]))
            return F.coalesce(short, plain)

        def step(x, at):
            card = lambda n: F.when(n.isNull(), x).otherwise(F.struct((at + n).alias("free"), F.concat(x["found"], F.array(F.struct(at.alias("at"), n.alias("n")))).alias("found")))
            return F.when((at < x["free"]) | (F.size(F.get(valid, at - 1)) == 0), x).otherwise(_let(best(at), card))

        none = F.struct(F.lit(1).alias("free"), F.array().cast("array<struct<at:int,n:int>>").alias("found"))
        return F.aggregate(F.sequence(F.lit(1), last), none, step, lambda x: x["found"])

    ahead = F.least(last + MOST_GROUPS - 1, F.size(groups))
    return _let(F.transform(F.sequence(F.lit(1), ahead), lambda at: _valid_at(groups, at)), scan)


def _run(m: Column, key: str, undo: bool) -> Column:
    """A run of digit groups with the cards in it permuted.

    A pseudonym that would move the cards (digits beside it make another card
    with some of its own) is permuted again, so ``undo`` finds the same ones.
    That is seen in the groups around it: of the cards before, those that end
    within ``REACH`` groups are found again, from a place between two cards.
    What is carried from card to card are the groups of those done.
    """
    one, beside = F.lit(1), MOST_GROUPS - 1

    def with_cards(groups, cards):
        card = lambda i: F.get(cards, i - 1)
        end = lambda i: card(i)["at"] + card(i)["n"]  # noqa: E731  the group behind it
        count = F.size(cards)

        def overlaid(low, high, first, last, value):
            """Groups ``low`` to ``high`` with ``value(i)`` for the cards ``first`` to ``last``."""
            def piece(i):
                begin = F.when(i == first, low).otherwise(end(i - 1))
                return F.concat(F.slice(groups, begin, card(i)["at"] - begin), value(i))
            rest = lambda begin: F.slice(groups, begin, F.greatest(high - begin + 1, F.lit(0)))
            return F.when(first > last, rest(low)).otherwise(F.concat(F.flatten(F.transform(F.sequence(first, F.greatest(first, last)), piece)), rest(end(last))))

        def step(out, k):
            at, n = card(k)["at"], card(k)["n"]
            ended = F.array_max(F.filter(F.sequence(F.greatest(k - REACH - 8, one), k), lambda i: end(i) <= at - REACH))

            def around(j):  # the last card that ends before the reach; 0: none
                first = F.greatest(F.when(j == 0, one).otherwise(end(j)), F.least(at - REACH, card(j + 1)["at"]))

                def local(begin):
                    place = at - begin + 1
                    want = F.transform(F.slice(cards, j + 1, k - j), lambda c: F.struct((c["at"] - begin + 1).alias("at"), c["n"].alias("n")))
                    if undo:  # the cards behind are done
                        last = F.coalesce(F.array_max(F.filter(F.sequence(k, F.least(k + beside, count)), lambda i: (i > k) & (card(i)["at"] < at + n + beside))), k)
                        behind = overlaid(at + n, at + n + beside - 1, k + 1, last, lambda i: F.get(out, count - i))
                        near = F.concat(F.slice(groups, begin, place + n - 1), behind)
                    else:
                        before = overlaid(begin, at - 1, j + 1, k - 1, lambda i: F.get(out, i - 1))
                        near = F.concat(before, F.slice(groups, at, n + beside))

                    def again(x, _):
                        old = _window(x["near"], place, n)
                        tail = F.substr(F.array_join(F.slice(x["near"], place, n), ""), F.length(old) + 1, one)
                        parts = F.filter(_groups(F.concat(_card(old, key, undo), tail)), lambda g: g != "")
                        new = F.concat(F.slice(x["near"], one, place - 1), parts, F.slice(x["near"], place + n, F.size(x["near"])))
                        same = lambda g: F.struct(g.alias("near"), (_cards(g, place) == want).alias("done"))
                        return F.when(x["done"], x).otherwise(_let(new, same))

                    return F.aggregate(F.sequence(one, F.lit(WALK)), F.struct(near.alias("near"), F.lit(False).alias("done")), again,
                                       lambda x: F.slice(x["near"], place, n))

                return _let(first, local)

            return F.concat(out, F.array(_let(F.coalesce(ended, F.lit(0)), around)))

        order = F.sequence(count, one, F.lit(-1)) if undo else F.sequence(one, count)
        done = F.aggregate(order, F.array().cast("array<array<string>>"), step)
        text = lambda out: F.array_join(overlaid(one, F.size(groups), one, count, lambda i: F.get(out, count - i if undo else i - 1)), "")
        return F.when(count == 0, m).otherwise(_let(done, text))

    return _let(_groups(m), lambda groups: _let(_cards(groups, F.size(groups)), lambda cards: with_cards(groups, cards)))


def _ip(m: Column, key: str, undo: bool) -> Column:
    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    valid = (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256) & (octet(4) < 256) & ~m.rlike(r"(^|\.)0[0-9]")
    new = feistel_numbers(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 1 << 16, 1 << 16, key, "ip", undo)
    show = lambda x: F.concat_ws(".", *[v.cast("string") for h in ("l", "r") for v in (F.floor(x[h] / 256).cast("int"), x[h] % 256)])
    return F.when(valid, _let(new, show)).otherwise(m)


FIRST_DAY, DAYS, MONTHS = "1900-01-01", 73049, 2400
LATE = DAYS - 12 * MONTHS  # dates with a day over 12; a prime, so permuted as 177 x 250 - 1


def _days_before(month: Column) -> Column:
    """Days from FIRST_DAY to the first of a month numbered from 0."""
    first = F.to_date(F.lit(FIRST_DAY))
    return F.datediff(F.add_months(first, month.cast("int")), first)


def _early_day(day: Column, key: str, undo: bool) -> Column:
    """The pseudonym of a day number whose day of the month is 1 to 12."""
    date = F.date_add(F.to_date(F.lit(FIRST_DAY)), day)
    rank = ((F.year(date) - 1900) * 12 + F.month(date) - 1) * 12 + F.day(date) - 1
    new = feistel_numbers(F.floor(rank / 180), rank % 180, 160, 180, key, "early", undo)
    return _let(_let(new, lambda x: x["l"] * 180 + x["r"]), lambda n: _days_before(F.floor(n / 12)) + n % 12)


def _late_day(day: Column, key: str, undo: bool) -> Column:
    """The pseudonym of a day number whose day of the month is 13 to 31."""
    date = F.date_add(F.to_date(F.lit(FIRST_DAY)), day)
    rank = day - 12 * ((F.year(date) - 1900) * 12 + F.month(date))
    other = lambda n: _let(feistel_numbers(F.floor(n / 250), n % 250, 177, 250, key, "late", undo), lambda x: x["l"] * 250 + x["r"])
    # the one number that is no date is walked over
    new = _let(other(rank), lambda n: F.when(n == LATE, other(F.lit(LATE))).otherwise(n))

    def day_of(n):
        late_before = lambda month: _days_before(month) - 12 * month
        near = F.floor(n * MONTHS / LATE)  # the month or one beside it
        month = near - 1 + F.when(late_before(near) <= n, 1).otherwise(0) + F.when(late_before(near + 1) <= n, 1).otherwise(0)
        return n + 12 * (month + 1)

    return _let(new, day_of)


def _date(m: Column, key: str, undo: bool) -> Column:
    """One permutation of day numbers for all forms, so a date has the same
    pseudonym however it is written.  Days up to 12 and over 12 stay apart:
    dd/MM/yyyy with a day over 12 is recognisable only by that."""
    first = F.to_date(F.lit(FIRST_DAY))
    part = lambda c, at, n: F.substr(c, F.lit(at), F.lit(n))
    year_first, day_first = m.rlike("^[0-9]{4}"), m.contains(".") | m.rlike(r"^(1[3-9]|[23][0-9])/")  # else month first
    iso = (
        F.when(year_first, F.translate(m, "/", "-")).when(day_first, F.concat_ws("-", part(m, 7, 4), part(m, 4, 2), part(m, 1, 2)))
        .otherwise(F.concat_ws("-", part(m, 7, 4), part(m, 1, 2), part(m, 4, 2)))
    )

    def show(new):  # an ISO date
        year, month, day = part(new, 1, 4), part(new, 6, 2), part(new, 9, 2)
        slashed = F.when(year_first, F.translate(new, "-", "/")).when(day_first, F.concat_ws("/", day, month, year)).otherwise(F.concat_ws("/", month, day, year))
        return F.when(m.contains("."), F.concat_ws(".", day, month, year)).when(m.contains("-"), new).otherwise(slashed)

    def other(day):
        new = F.when(F.day(F.date_add(first, day)) > 12, _late_day(day, key, undo)).otherwise(_early_day(day, key, undo))
        return F.when((day >= 0) & (day < DAYS), _let(F.date_add(first, new.cast("int")).cast("string"), show))

    return F.coalesce(_let(F.datediff(iso.try_cast("date"), first), other), m)


def _ssn(m: Column, key: str, undo: bool) -> Column:
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # areas 1-665 and 667-899 are numbered 0-664 and 665-897
    new = feistel_numbers(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", undo)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    show = lambda x: F.concat_ws("-", pad(x["l"] + F.when(x["l"] > 664, 2).otherwise(1), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4))
    return F.when(valid, _let(new, show)).otherwise(m)


def _after(m: Column, prefix: str, key: str, kind: str, undo: bool) -> Column:
    """The prefix stays, the rest is permuted."""
    head = F.regexp_extract(m, prefix, 0)
    return F.concat(head, feistel_text(F.substr(m, F.length(head) + 1, F.length(m)), key, kind, undo))


KINDS = ("email", "secret", "ip", "date", "ssn", "phone", "card")


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"[A-Za-z]"), "secret").when(whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), "ip")
        .when(whole(r"[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}"), "date").when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), "ssn")
        .when(m.rlike(r"^[0-9](?:[ -]?[0-9]){12}"), "card").otherwise("phone")
    )


def pseudonym(m: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one match (the match itself if it is not valid)."""
    at = F.instr(m, "@")
    email = F.concat(feistel_text(F.substr(m, F.lit(1), at - 1), key, "email", undo), F.substr(m, at, F.length(m)))
    kind = kind_of(m)
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", _after(m, r"^(?:AKIA|[a-z_]+\s*[=:]\s*\"?)", key, "secret", undo))
        .when(kind == "ip", _ip(m, key, undo)).when(kind == "date", _date(m, key, undo)).when(kind == "ssn", _ssn(m, key, undo))
        .when(kind == "card", _run(m, key, undo)).otherwise(_phone(m, key, undo))
    )


def _replaced(text: Column, key: str, undo: bool) -> tuple[Column, Column]:
    """(matches, their replacements) of a text; empty for most."""
    found = F.when(text.rlike("[0-9@]|AKIA|password|passwd|token|secret|api_key"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>")), lambda ms: F.transform(ms, lambda m: pseudonym(m, key, undo))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False, report: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, all columns as they were.

    ``report`` adds ``pii_found`` (candidates), ``pii_replaced`` (valid ones)
    and ``pii_kinds`` (sorted kinds of those replaced); a run of digit groups
    is one candidate however many cards it holds.  ``undo`` with the
    same key restores the original text.
    """
    cols = docs.columns
    matches, new = _replaced(F.col(f"`{text_col}`"), key, undo)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(f"`{text_col}`").alias("text"), matches.alias("old"))
    row = row.withColumn("new", F.when(F.size("old") > 0, new(F.col("old"))).otherwise(F.col("old")))
    pieces = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("new"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    row = row.withColumn("text", F.when(F.size("old") > 0, joined).otherwise(F.col("text")))
    out = row.withColumn("row", F.col("row").withField(f"`{text_col}`", F.col("text")))
    if not report:
        return out.select("row.*")
    done = F.filter(F.zip_with("old", "new", lambda o, n: F.when(o != n, kind_of(o))), lambda k: k.isNotNull())
    kept = [F.col("row").getField(c).alias(c) for c in cols if c not in ("pii_found", "pii_replaced", "pii_kinds")]
    return out.select(*kept, F.size("old").alias("pii_found"), F.size(done).alias("pii_replaced"), F.array_join(F.array_sort(F.array_distinct(done)), ",").alias("pii_kinds"))
