import datetime
import hashlib
import re

from pyspark.sql import functions as F

from veritrail.llm import pii


def run(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [(r.text, r.pii_kinds) for r in pii.pseudonymise(rows, key).orderBy("i").collect()]


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0


FORMS = {
    "card": (["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005"], lambda a, b: luhn(b) and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) and a[0] == b[0]),
    "ssn": (["123-45-6789", "899-99-9999", "001-01-0001"], lambda a, b: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", b)),
    "phone": (["+1 (743) 555-3824", "415-555-1234", "415.555.1234"], lambda a, b: re.sub(r"\d", "9", a) == re.sub(r"\d", "9", b) and b[:2] == a[:2] if a[0] == "+" else True),
    "ipv4": (["152.143.123.131", "0.0.0.0", "255.255.255.255"], lambda a, b: all(0 <= int(p) <= 255 for p in b.split("."))),
    "date": (["1984-02-29", "2199-12-31", "1800-01-01"], lambda a, b: datetime.date.fromisoformat(b)),
    "email": (["hein.19@mail5.example.com", "A.b+c@x.org"], lambda a, b: a.partition("@")[2] == b.partition("@")[2] and re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", a))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", b)))),
}


def test_formats_stay_and_equal_values_stay_linked(spark):
    values = [(kind, v) for kind, (vs, _) in FORMS.items() for v in vs]
    got = run(spark, [f"x {v}, then {v}### end" for _, v in values])
    for (kind, value), (text, kinds) in zip(values, got, strict=True):
        first, second = re.fullmatch(r"x (.*), then (.*)### end", text).groups()
        assert kinds == [kind, kind] and first == second != value
        assert FORMS[kind][1](value, first)
    assert run(spark, ["1984-02-29"], "other") != run(spark, ["1984-02-29"])
    assert run(spark, ["31/12/1999 01.02.2003"])[0][0][2] == "/"


def test_invalid_and_clean_texts_stay(spark):
    texts = ["4111111111111112", "000-12-3456 666-12-3456", "999.1.1.1 1.2.3.4.5 01.2.3.4", "1985-02-29 1799-12-31", "a@b", "room 12 345", "the end.", "x4111111111111111", None, ""]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_permutations(spark):
    pairs = spark.range(27 * 50).select((F.col("id") % 27).alias("x"), F.floor(F.col("id") / 27).alias("y"))
    got = pairs.select(pii.permute(F.col("x"), F.col("y"), 27, 50, "k", "t").alias("p")).select("p.*")
    assert got.distinct().count() == 27 * 50 and got.filter("x between 0 and 26 and y between 0 and 49").count() == 27 * 50
    addresses = spark.range(3000).select(F.col("id").alias("i"), F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col("id") / 256).cast("string"), (F.col("id") % 256).cast("string")).alias("text"))
    assert pii.pseudonymise(addresses, "k").select("text").distinct().count() == 3000


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "4111111111111111 4111111111111111", "y"), (2, "4111111111111111 4111111111111111", "y"), (None, "é😀 " * 50_000 + "1984-02-29", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_kinds string")
    out = pii.pseudonymise(docs, "k")
    assert out.columns == docs.columns and sorted(len(r.pii_kinds) for r in out.collect()) == [0, 1, 2, 2]
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_values_beside_other_numbers(spark):
    card, ssn, phone = "4111 1111 1111 1111", "123-45-6789", "212-555-1234"
    texts = [(f"{card} 12/25", ["card"]), (f"{card} 123", ["card"]), ("4111111111111111 123 12/25", ["card"]), (f"in 2024 {ssn}", ["ssn"]), (f"room 1200 {phone}", ["phone"]), (f"{ssn} 1200", ["ssn"]), (f"{phone} 2024 1", ["phone"])]
    texts += [(f"no. 77 {card} 5", ["card"]), (f"12-{card}", ["card"]), (f"{card}-12", ["card"]), ("2024 3782 822463 10005 99", ["card"]), (f"{card} {ssn} {phone}", ["card", "ssn", "phone"]), (f"{phone} {card} {phone}", ["phone", "card", "phone"]), (f"1985-02-29 {ssn} 1984-02-29", ["ssn", "date"])]
    alone = {v: new for v, (new, _) in zip((card, ssn, phone, "1984-02-29", "3782 822463 10005", "4111111111111111"), run(spark, [card, ssn, phone, "1984-02-29", "3782 822463 10005", "4111111111111111"]), strict=True)}
    for (text, kinds), got in zip(texts, run(spark, [t for t, _ in texts]), strict=True):
        for old, new in alone.items():
            text = text.replace(old, "<" + new + ">")
        assert got == (text.replace("<", "").replace(">", ""), kinds)


def test_unusual_groupings_give_way(spark):
    assert luhn("2024 123-45-6780") and luhn("4111 11-1111 11 1111")
    (text, kinds), (_, alone) = run(spark, ["in 2024 123-45-6780 x", "4111 11-1111 11 1111"])
    assert kinds == ["ssn"] and text.startswith("in 2024 ") and "6780 x" not in text and alone == ["card"]


def feistel(x, y, size_x, size_y, tweak, key="k"):
    noise = lambda turn, other: int(hashlib.sha256(f"{key}|{tweak}|{turn}|{other}".encode()).hexdigest()[:13], 16)
    for k in range(0, pii.ROUNDS, 2):
        x = (x + noise(k, y)) % size_x
        y = (y + noise(k + 1, x)) % size_y
    return x, y


def plain(kind, value):
    """The pseudonym in plain Python."""
    d = re.sub(r"\D", "", value)
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, kind)
        area = x // 99 + 1 + (x // 99 >= 665)
        return f"{area:03}-{x % 99 + 1:02}-{y + 1:04}"
    if kind == "ipv4":
        a, b, c, e = map(int, value.split("."))
        x, y = feistel(a * 256 + b, c * 256 + e, 65536, 65536, kind)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        n = (datetime.date.fromisoformat(value) - first).days
        x, y = feistel(n // 5411, n % 5411, 27, 5411, kind)
        return (first + datetime.timedelta(x * 5411 + y)).isoformat()
    if kind == "phone":
        code, d = d[:-10], d[-10:]
        x, y = feistel(((int(d[0]) - 2) * 8 + int(d[3]) - 2) * 10_000 + int(d[1:3]) * 100 + int(d[4:6]), int(d[6:]), 640_000, 10_000, kind)
        lead, rest = divmod(x, 10_000)
        new = code + f"{lead // 8 + 2}{rest // 100:02}{lead % 8 + 2}{rest % 100:02}{y:04}"
    else:
        left, right = (len(d) - 1) // 2, -(-(len(d) - 3) // 2)
        x, y = feistel(int(d[1 : 1 + left]), int(d[1 + left : 1 + left + right]), 10**left, 10**right, kind)
        new = d[0] + f"{x:0{left}}{y:0{right}}"
        new += next(c for c in "0123456789" if luhn(new + c))
    turn = iter(new)
    return re.sub(r"\d", lambda _: next(turn), value)


def test_pseudonyms_equal_plain_python(spark):
    values = [(kind, v) for kind, (vs, _) in FORMS.items() if kind != "email" for v in vs]
    got = run(spark, [f"a {v} b" for _, v in values])
    assert [text for text, _ in got] == [f"a {plain(kind, v)} b" for kind, v in values]


def test_a_column_named_like_its_own_stays(spark):
    rows = spark.createDataFrame([(1, "mine", "123-45-6789")], "i long, __pii string, text string")
    got = pii.pseudonymise(rows, "k").first()
    assert got["__pii"] == "mine" and got.pii_kinds == ["ssn"] and got.text != "123-45-6789"
