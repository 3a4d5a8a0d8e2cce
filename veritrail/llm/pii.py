"""Format-preserving pseudonyms of personal data, in DataFrame operations only.

A regex finds every place where a candidate starts, also inside other candidates; each must pass its kind's validation before it
takes any text, so an invalid one hides nothing. Of valid ones that overlap the first wins, of those with one start the longest. A
valid value is numbered within its format, permuted there by a keyed Feistel network, and written back in the same form: equal
values get equal pseudonyms in all documents, different ones different pseudonyms, and a pseudonym is again a valid value of its kind.

- card: 13 to 19 digits, also in groups, with a right Luhn digit; the first digit stays, the last is computed anew. Beside other
  numbers it is found unbroken or in groups of 4-4-4-4, 4-4-4-4-3, 4-6-5 or 4-6-4, also behind a digit and a hyphen. Other
  groupings count from a group of four or more digits as far as digits go on, and only where no other valid value overlaps
- ssn: AAA-GG-SSSS with a legal area, group and serial number
- phone: North American numbers; area and exchange start with 2 to 9
- ipv4: four numbers up to 255, without leading zeros
- date: YYYY-MM-DD, DD/MM/YYYY or DD.MM.YYYY, a calendar day of 1800 to 2199 (400 years are 27 * 5411 days)
- email: letters and digits before the @ are permuted within their class, character by character; the domain stays

A null text stays null, an empty one empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.shared import free_name, let

KINDS = ("email", "date", "ipv4", "ssn", "phone", "card")
ROUNDS = 8

#: Regexes of the kinds' forms; an e-mail address has its own.
_FORMS = {
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}",
    "card": r"[0-9]{4}(?:[ -]?[0-9]){9,15}",
}
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_END = r"(?![0-9A-Za-z])(?!\.[0-9])"
#: Usual groupings of cards, the longest first; 19 digits only where no further group follows, as that may be a phone number.
_CARDS = (r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}(?![ -][0-9])", "[0-9]{13,19}", r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4}")
_EMAIL_START = r"(?<![A-Za-z0-9._%+-])"
#: Places where a candidate starts, without width. WINDOW has what follows: an e-mail address, or more than the longest number.
STARTS = rf"{_EMAIL_START}(?={_EMAIL})|(?<![0-9A-Za-z])(?<![0-9][.-])(?=(?:{'|'.join(_FORMS.values())}){_END})|(?<=[0-9]-)(?=(?:{'|'.join(_CARDS)}){_END})"
WINDOW = rf"(?s)(?:{STARTS})(?=({_EMAIL_START}{_EMAIL}|.{{0,40}}))"
#: A start is at least two characters from the next, a number at most 37 long.
_NEAR = 18


def _number(text: Column) -> Column:
    return text.cast("long")


def _noise(key: str, tweak: str, turn: Column, other: Column) -> Column:
    """52 pseudo-random bits of the key, the kind, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permute(x: Column, y: Column, size_x, size_y, key: str, tweak: str) -> Column:
    """struct(x, y): a keyed permutation of the pairs below (size_x, size_y), both up to 10^10."""
    size_x, size_y = (s if isinstance(s, Column) else F.lit(s).cast("long") for s in (size_x, size_y))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def turn(s: Column, k: Column) -> Column:
        a = (s.x + _noise(key, tweak, k * 2, s.y)) % size_x
        return let(a, lambda a: F.struct(a.alias("x"), ((s.y + _noise(key, tweak, k * 2 + 1, a)) % size_y).alias("y")))

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS // 2))), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _padded(n: Column, width) -> Column:
    """n with leading zeros, of width characters."""
    width = width if isinstance(width, Column) else F.lit(width)
    return F.when(width > 0, F.concat(F.repeat(F.lit("0"), width - F.length(n.cast("string"))), n.cast("string"))).otherwise("")


def _reshaped(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn by others, as many."""
    letters = F.split(form, "")
    at = lambda k: F.length(_digits(F.substring(form, F.lit(1), k + 1)))
    return F.array_join(F.transform(letters, lambda c, k: F.when(c.rlike("^[0-9]$"), F.substring(digits, at(k), F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of the digits, counted from the right; every second one doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, k: let(c.cast("int") * (k % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def _card(value: Column, key: str) -> tuple[Column, Column]:
    d = _digits(value)
    n = F.length(d)
    valid = n.between(13, 19) & (_luhn(d) % 10 == 0)
    left, right = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 3) / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    mixed = permute(_number(F.substring(d, F.lit(2), left)), _number(F.substring(d, left + 2, right)), power(left), power(right), key, "card")
    body = let(mixed, lambda m: F.concat(F.substring(d, 1, 1), _padded(m.x, left), _padded(m.y, right)))
    full = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return valid, let(full, lambda f: _reshaped(value, f))


def _ssn(value: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (_number(F.substring(value, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 0 to 897
    mixed = permute(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def form(m: Column) -> Column:
        p = F.floor(m.x / 99)
        return F.concat_ws("-", _padded(F.when(p >= 665, p + 2).otherwise(p + 1), 3), _padded(m.x % 99 + 1, 2), _padded(m.y + 1, 4))

    return valid, let(mixed, form)


def _phone(value: Column, key: str) -> tuple[Column, Column]:
    d = F.right(_digits(value), F.lit(10))
    at = lambda k, n: _number(F.substring(d, k, n))
    mixed = permute(((at(1, 1) - 2) * 8 + at(4, 1) - 2) * 10_000 + at(2, 2) * 100 + at(5, 2), at(7, 4), 640_000, 10_000, key, "phone")

    def form(m: Column) -> Column:
        lead, rest = F.floor(m.x / 10_000), m.x % 10_000
        new = F.concat((F.floor(lead / 8) + 2).cast("string"), _padded(F.floor(rest / 100), 2), (lead % 8 + 2).cast("string"), _padded(rest % 100, 2), _padded(m.y, 4))
        code = F.length(_digits(value)) - 10
        return let(F.concat(F.left(_digits(value), code), new), lambda x: _reshaped(value, x))

    return F.lit(True), let(mixed, form)


def _ipv4(value: Column, key: str) -> tuple[Column, Column]:
    parts = F.split(value, r"\.")
    valid = F.forall(parts, lambda p: (p.cast("int") <= 255) & ((p == "0") | ~p.startswith("0")))
    at = lambda k: _number(F.get(parts, k))
    mixed = permute(at(0) * 256 + at(1), at(2) * 256 + at(3), 65536, 65536, key, "ipv4")
    return valid, let(mixed, lambda m: F.concat_ws(".", *(v.cast("string") for h in (m.x, m.y) for v in (F.floor(h / 256), h % 256))))


def _date(value: Column, key: str) -> tuple[Column, Column]:
    iso = F.when(value.contains("-"), value).otherwise(F.concat_ws("-", F.right(value, F.lit(4)), F.substring(value, 4, 2), F.left(value, F.lit(2))))
    day = F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
    first = F.lit("1800-01-01").cast("date")
    valid = F.coalesce(F.year(day).between(1800, 2199), F.lit(False))
    mixed = let(F.datediff(day, first).cast("long"), lambda n: permute(F.floor(n / 5411), n % 5411, 27, 5411, key, "date"))

    def form(m: Column) -> Column:
        new = F.date_add(first, (m.x * 5411 + m.y).cast("int")).cast("string")
        return let(new, lambda s: F.when(value.contains("-"), s).otherwise(F.concat(F.right(s, F.lit(2)), F.substring(value, 3, 1), F.substring(s, 6, 2), F.substring(value, 3, 1), F.left(s, F.lit(4)))))

    return valid, let(mixed, form)


def _email(value: Column, key: str) -> tuple[Column, Column]:
    name = F.substring_index(value, "@", 1)
    half = F.ceil(F.length(name) / 2).cast("int")

    def shifted(part: Column, other: Column, turn: Column) -> Column:
        """part with each letter and digit moved within its class as the other half says."""
        noise = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), turn.cast("string"), F.length(part).cast("string"), other), 256)

        def moved(bits: Column, c: Column, k: Column) -> Column:
            step = F.conv(F.substring(bits, k % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + k
            within = lambda low, size: F.chr((F.ascii(c) - low + step) % size + low)
            return F.when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).when(c.rlike("^[0-9]$"), within(48, 10)).otherwise(c)

        return let(noise, lambda bits: F.array_join(F.transform(F.split(part, ""), lambda c, k: moved(bits, c, k)), ""))

    def turn(s: Column, k: Column) -> Column:
        return let(shifted(s.x, s.y, k * 2), lambda x: F.struct(x.alias("x"), shifted(s.y, x, k * 2 + 1).alias("y")))

    start = F.struct(F.left(name, half).alias("x"), F.substring(name, half + 1, F.lit(64)).alias("y"))
    mixed = F.aggregate(F.array(*map(F.lit, range(ROUNDS // 2))), start, turn)
    return F.lit(True), let(mixed, lambda m: F.concat(m.x, m.y, F.lit("@"), F.substring_index(value, "@", -1)))


def _found(window: Column, key: str) -> Column:
    """struct(kind, value, new, weak) of the valid value at the start of a window, else null; weak: a card in an unusual grouping."""
    at_start = lambda form: F.regexp_extract(window, f"^(?:{form}){_END}", 0)

    def checked(kind: str, value: Column, make, weak: Column) -> Column:
        def struct(v: Column) -> Column:
            valid, new = make(v, key)
            return F.when(valid, F.struct(F.lit(kind).alias("kind"), v.alias("value"), new.alias("new"), weak.alias("weak")))

        return let(value, lambda v: F.when(F.length(v) > 0, struct(v)))

    email = checked("email", F.regexp_extract(window, rf"^{_EMAIL}\z", 0), _email, F.lit(False))
    others = [checked(kind, at_start(_FORMS[kind]), make, F.lit(False)) for kind, make in (("date", _date), ("ipv4", _ipv4), ("ssn", _ssn), ("phone", _phone))]
    usual = F.filter(F.array(*map(at_start, _CARDS)), lambda v: _card(v, key)[0])
    cards = [checked("card", F.get(usual, F.lit(0)), _card, F.lit(False)), checked("card", at_start(_FORMS["card"]), _card, F.lit(True))]
    return F.coalesce(email, *others, *cards)


def _taken(pieces: Column, found: Column) -> Column:
    """struct(end, parts, kinds): the text's parts with new values, from its pieces before, between and behind the starts."""
    start = F.struct(F.lit(0).alias("end"), F.array(F.get(pieces, F.lit(0))).alias("parts"), F.array().cast("array<string>").alias("kinds"))
    sizes = F.transform(pieces, lambda p: F.length(p))
    begins = F.aggregate(F.slice(sizes, 2, F.size(sizes)), F.array(F.lit(0)), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))

    def step(at: Column) -> Column:
        def chosen(s: Column, i: Column) -> Column:
            f, begin, piece = F.get(found, i), F.get(at, i), F.get(pieces, i + 1)
            until = begin + F.length(f.value)
            strong = F.exists(F.sequence(i + 1, i + _NEAR), lambda j: (F.get(at, j) < until) & ~F.get(found, j).weak)
            take = f.isNotNull() & (begin >= s.end) & ~(f.weak & F.coalesce(strong, F.lit(False)))

            def put(t: Column) -> Column:
                end = F.when(t, until).otherwise(s.end)
                rest = F.substring(piece, F.greatest(end - begin, F.lit(0)) + 1, F.length(piece))
                return F.struct(end.alias("end"), F.concat(s.parts, F.array(F.when(t, f.new).otherwise(""), rest)).alias("parts"), F.when(t, F.array_append(s.kinds, f.kind)).otherwise(s.kinds).alias("kinds"))

            return let(F.coalesce(take, F.lit(False)), put)

        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, chosen)

    return let(begins, step)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str = "pii_kinds") -> DataFrame:
    """docs with pseudonyms in the text, and the kinds replaced (array<string>, in text order) in a column of that name.

    A column of that name is replaced; all others and all rows stay.
    """
    led = F.concat(F.lit(" "), F.col(text))  # a start at the very beginning would not be split off
    values = F.transform(F.regexp_extract_all(led, F.lit(WINDOW), F.lit(1)), lambda w: _found(w, key))
    own = free_name(docs, "__pii")
    docs = docs.withColumn(own, F.when(F.col(text).rlike(r"[0-9]|@"), values))
    some = F.exists(own, lambda f: f.isNotNull())
    docs = docs.withColumn(own, F.when(some, let(F.split(led, STARTS), lambda pieces: _taken(pieces, F.col(own)))))
    rebuilt = F.array_join(F.col(own)["parts"], "").substr(F.lit(2), F.lit(2**31 - 1))
    kinds = F.coalesce(F.col(own)["kinds"], F.array().cast("array<string>"))
    return docs.withColumns({text: F.when(F.col(own).isNotNull(), rebuilt).otherwise(F.col(text)), found: kinds}).drop(own)
