"""The whole news cleaning pipeline (P2) against a plain sequential pass, and its step counts."""
import datetime
import re
import unicodedata

from quantloom.functions import text as T
from quantloom.functions.similarity import indel_ratio
from quantloom.operators import news as N

BASE = datetime.datetime(2024, 1, 2, 10, 0, 0, 250000)
LONG = "Shares of the maker rose on Tuesday after it said that sales in the quarter had grown more than expected. "


def plain_clean(text):
    for a, b in zip(T.CURLY_QUOTES, T.STRAIGHT_QUOTES):
        text = text.replace(a, b)
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    for pattern, token in ((T.URL_RE, T.URL_TOKEN), (T.EMAIL_RE, T.EMAIL_TOKEN), (T.PHONE_RE, T.PHONE_TOKEN)):
        text = re.sub(pattern, token, text)
    return re.sub(r"\s+", " ", text).strip(" ")


def rows():
    out = []

    def add(symbol, minutes, headline, body):
        out.append((len(out) + 1, symbol, BASE + datetime.timedelta(minutes=minutes), headline, body))
    add("A", 0, "Maker beats forecasts", LONG * 3)
    add("A", 5, "UPDATE 1-Maker beats forecasts", LONG * 3 + "Chief executive said so.")
    add("A", 9, "UPDATE 2-Maker beats forecasts", "CITY, Jan 2 (Reuters) - " + LONG * 3)
    add("A", 400, "Quotes", "Don’t “buy” it — café, says http://example.com/x a@b.com")
    add("A", 410, "Quo tes", "Another body altogether with other words in it")
    add("A", 420, "Straight", "Don't \"buy\" it  cafe, says http://example.com/y c@d.com")
    add("A", 430, "Something else", "zzz qqq xxx 12345 qqq zzz")
    add("A", 440, "Something else.", "The board met in the morning and chose a new chair for the coming year")
    add("B", 1, "Maker beats forecasts", LONG * 3)
    for k in range(12):
        add("B", 10 + k, f"Plant {k} opens", (f"Plant number {k} " + "opens near the river and the road " * (1 + k % 3)))
    add(None, 3, "No symbol", "A body without a symbol")
    return out


def plain_pipeline(raw):
    steps = {"raw": len(raw)}
    data = []
    for i, sym, at, head, body in raw:
        m = re.match(r"UPDATE (\d+)", head)
        cut = body.find("(Reuters)")
        data.append({"id": i, "sym": sym, "at": at, "up": int(m[1]) if m else 0, "new": re.sub(r"UPDATE \d+-", "", head),
                     "body": body[cut:] if cut >= 0 else body})

    def first(rows_, key, order):
        seen = {}
        for r in sorted(rows_, key=order):
            seen.setdefault((r["sym"], key(r)), r)
        return list(seen.values())
    newest = lambda r: (-r["at"].timestamp(), r["id"])
    data = first(data, lambda r: r["new"], lambda r: (-r["up"], *newest(r)))
    steps["newest_update"] = len(data)
    data = first(data, lambda r: r["body"].replace(" ", ""), newest)
    steps["distinct_body"] = len(data)
    data = first(data, lambda r: r["new"].replace(" ", ""), newest)
    steps["distinct_headline"] = len(data)
    for r in data:
        r["clean"], r["sec"] = plain_clean(r["body"]), r["at"].replace(microsecond=0)
    data = first(data, lambda r: r["clean"], lambda r: (r["sec"], r["id"]))
    steps["distinct_cleaned_body"] = len(data)
    for col, limit, step in (("clean", 0.6, "similar_body"), ("new", 0.9, "similar_headline")):
        data.sort(key=lambda r: (str(r["sym"]), r["sec"], r["id"]))
        data = [r for k, r in enumerate(data) if not (k and data[k - 1]["sym"] == r["sym"]
                                                      and indel_ratio(r[col], data[k - 1][col]) > limit)]
        steps[step] = len(data)
    return sorted((r["id"], str(r["sym"]), r["new"], r["clean"]) for r in data), steps


def test_clean_news_equals_a_plain_pass_and_counts_its_steps(spark):
    raw = rows()
    df = spark.createDataFrame(raw, "item_id long, symbol string, dates timestamp_ntz, headline string, body string").repartition(4)
    counts = {}
    out = N.clean_news(df, counts=counts)
    got = sorted((r.item_id, str(r.symbol), r.headline, r.body) for r in out.collect())
    expected, steps = plain_pipeline(raw)
    assert got == expected
    assert {s: counts[s].get["n"] for s in N.CLEAN_STEPS} == steps
    assert sorted((r.item_id, str(r.symbol), r.headline, r.body) for r in N.clean_news(df).collect()) == expected


def test_typographic_quotes_reach_the_pipeline(spark):
    df = spark.createDataFrame([(1, "A", BASE, "h", "Don’t “buy” it — café")],
                               "item_id long, symbol string, dates timestamp_ntz, headline string, body string")
    assert [r.body for r in N.clean_news(df).collect()] == ['don\'t "buy" it cafe']


def test_text_chain_equals_the_plain_rules(spark):
    """The ASCII shortcut, the bound fold and the faster patterns change no result."""
    import re
    import unicodedata
    plain = ((r"(?i)\b(?:https?://|ftp://|www\.)[^\s<>\"]+", T.URL_TOKEN),
             (r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", T.EMAIL_TOKEN),
             (r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}\b", T.PHONE_TOKEN))
    texts = ["WWW.A.com/x?y=1\n a..b+c@D.e.org, x@y.c a@b@c.de", "+1 (212) 555-0123 call 212.555.0123x 1-212-555 01234",
             "café “naïve” ﬁne ½ ’tis", "a" * 5000 + "@", "xhttp://u http://u(1)555", "", None,
             "(123)456 7890 ++12 345 678 9012 a-b.c_d%e@f.gg", "élan@x.com ftp://ü.de",
             "".join(map(chr, range(0xc0, 0x180))) + "ﬁ½\U0001d400é", "\U0001d400\U0001f600é\u0301ﬁﬁ"]
    def clean(t):
        t = (t or "").translate(str.maketrans(T.CURLY_QUOTES, T.STRAIGHT_QUOTES))
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        for pattern, token in plain:
            t = re.sub(pattern, token, t)
        return re.sub(r"\s+", " ", t).strip(" ")
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.clean_text("t").alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: clean(t) for i, t in enumerate(texts)}


def test_similarity_stops_when_it_is_decided():
    import random

    from quantloom.functions import similarity as S
    rnd = random.Random(5)
    for k in range(300):
        a = "".join(rnd.choices("abcdef é\U0001f600", k=rnd.randint(1, 700)))
        b = "".join(c for c in a if rnd.random() > .3) if k % 2 else "".join(rnd.choices("abcdef ", k=rnd.randint(1, 700)))
        ratio = S.indel_ratio(a, b)
        for r in (0.0, 0.5, 0.6, 0.9, ratio):
            assert S.is_similar(a, b, r) == (ratio > r)
    asked = []

    def enough(n):
        asked.append(n)
        return n > 500
    assert S._lcs("x" * 100_000, "x" * 100_000, enough) < 2000 and len(asked) < 20
