"""Personal data: base spans against plain expressions, added spans, no Python on the way."""

import hashlib
import random
import re

from trafficscore.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]


def card(rng, n=16):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if passes("card", body + c))


ODD = ["a@b.co_x@c.de a@b..c @x.y a.b@c.d-e.f. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.2.3 1.2.3.4444",
       "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111111", "+1 (907) 555-1190 +12 +1-+1234567890 ++123456789 +1 2 ",
       "é😀 x.y@é.com x.y@mail.com 😀 +49 30 1234567", "1" * 9000, "1 " * 9000, "a" * 9000 + "@b.c", "a.b" * 3000, "+" * 500 + "1" * 5000,
       "1." * 5000, "x@" * 3000 + "y.z", "a@b" + ".c" * 5000]


def check(rows, got):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        want = plain(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, (text or "")[:80])
        assert set(want) <= set(got[i].spans.split(",")) | ({""} if not want else set())
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(
            sum(s.startswith(k + ":") for s in want) for k in PLAIN)


def test_base_spans_equal_plain_expressions(documents, odd_texts):
    rng = random.Random(6)
    odd = ["".join(rng.choice("0123456789 .-+()@ab") for _ in range(rng.randint(1, 120))) for _ in range(150)]
    odd += [f"x {card(rng, n)} y {card(rng, n)[:-1]}" for n in range(13, 20)] + ["123456789012 12345678901234567890"]
    rows = list(enumerate([*ODD, *odd, *odd_texts]))
    check(rows, pii.report(documents(rows)).collect())


def test_query_over_the_whole_table(spark, read):
    rows = [(r.doc_id, r.text) for r in read("documents").collect()]
    check(rows, queries.op5_pii(spark, "/root/testdata/sf0.001").collect())


def test_model_adds_spans_of_the_same_format_and_leaves_others(documents):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        rows.append((i, f"please call me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or so"))
        rows.append((1000 + i, f"order {rng.randint(10**7, 10**8)} of {rng.randint(10**8, 10**9)} went out"))
    rows += [(5000 + i, f"please call me at ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or so") for i in range(3)]
    rows += [(6000, "send 40000000000 and 1234567 units")]
    got = {r.doc_id: r.spans for r in pii.report(documents(rows)).collect()}
    assert not any(got[1000 + i] for i in range(400)) and got[6000] == ""
    assert all(got[i].startswith("phone:") for i in range(400))


def test_model_adds_addresses_and_cards_in_other_forms(documents):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        rows.append((i, f"write to user{i}@host{i % 7}.org or so"))
        rows.append((1000 + i, f"write to user{i} [at] host{i % 7} [dot] org or so"))
        c = card(rng, 16)
        rows.append((2000 + i, f"pay by card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} now"))
        rows.append((3000 + i, f"order {rng.randint(10**7, 10**8)} went out"))
    got = {r.doc_id: r for r in pii.report(documents(rows)).collect()}
    for i in range(300):
        assert got[1000 + i].n_email == 0 and got[1000 + i].spans == f"email:9:{len(rows[4 * i + 1][1]) - 6}"
        assert got[2000 + i].n_card == 0 and got[2000 + i].spans == "card:12:31"
        assert got[3000 + i].spans == ""


def test_trees_as_expressions_equal_the_model(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(400, len(pii.FEATURES)))
    y = ((x[:, 0] > 2) & (x[:, 3] < 4)).astype(float)
    model = pii.boost(x, y, np.ones(400), rng.random(400) < 0.6)
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in x], ", ".join(f"{f} int" for f in pii.FEATURES))
    from pyspark.sql import functions as F
    got = df.select(model.column(F.struct(*pii.FEATURES)).alias("s")).collect()
    assert np.allclose([r.s for r in got], model.total(x))
    assert ((model.total(x) >= model.threshold) == y).mean() > 0.95


def test_no_python_on_the_way_and_empty(documents):
    df = pii.report(documents([(1, "a@b.co"), (2, None)]))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert pii.report(documents([])).collect() == []
