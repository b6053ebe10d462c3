import hashlib
import random
import re

import numpy as np

from signalmill.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def noise(rnd, n):
    return "".join(rnd.choice("ab.@19 +()-0257\n%_é") for _ in range(n))


def cases():
    rnd = random.Random(5)
    texts = [None, "", "@", "a@b", "a@b@c.de", "x.y@z.com.", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111 x", "+1 (555) 234-5678, 10.0.0.1"]
    texts += ["é" * 10 + "u.v+w@ex-1.example.org é", "1" * 30_000, "a" * 30_000 + "@", "1." * 9000, "+1" * 9000, "@a.b" * 4000, "(at)" * 5000, "٣٣٣.1.2.3.4"]
    return texts + [noise(rnd, rnd.randrange(10, 400)) for _ in range(600)]


def test_base_matches_against_the_patterns():
    for text in cases():
        if text and len(text) > 20_000:
            P.candidates(text)  # in linear time
            continue
        got = [(s, k, e) for s, k, e, f in P.candidates(text or "") if f == "base"]
        got.sort(key=lambda c: (c[0], P.KINDS.index(c[1])))
        assert P.render(got) == brute(text), repr(text)


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    out = []
    for i in range(400):
        mail = f"{word()}.{word()}@{word()}.example.com"
        phone = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        ip = ".".join(str(rnd.randrange(1, 255)) for _ in range(4))
        bits = [word() for _ in range(20)]
        bits[5] = (mail, phone, ip, "4111111111111111")[i % 4]
        bits[12] = (f"{rnd.randrange(10**15, 10**16)}", "4.0.300.1", "id=12345", "v1.2.3.999")[i % 4]
        out.append(" ".join(bits))
    return out


def test_loose_forms_are_found_and_base_matches_stay():
    model = P.fit_model(corpus(), P.PiiOptions())
    assert {"at_words", "local_phone", "split_ip"} <= set(model.thresholds)
    hit = lambda t: [t[s:e] for s, _, e, f in model.select(t) if f != "base"]
    assert hit("please ask jo.smith (at) mail.example.com about it") == ["jo.smith (at) mail.example.com"]
    assert hit("ring dad on (555) 234-5678 now") == ["(555) 234-5678"]
    assert hit("the box 10[.]20[.]30[.]40 was up") == ["10[.]20[.]30[.]40"]
    assert hit("meet me (at) noon and the rest 16 17 18") == []
    for text in corpus()[:50]:
        assert P.render([c for c in model.select(text) if c[3] == "base"]) == brute(text)


# Texts by hand: (kind or None, text with the span in braces). None of them comes from the forms that the trees learn.
WRITTEN = [
    ("secret", 'he cun token = "{5f2b8c1e9d7a4436b0e1f29c83ad5571e6409bd2}" dat la'),
    ("secret", "set the password = {tr0ub4dor&3x!} before you go"),
    ("secret", "DB_PASSWORD={Zx9!kPq2mW} in the env file"),
    ("secret", "client_secret: {q8Zt5LxNw2Rb7VyKc4Hd9MfJg3Ps6TaE}"),
    ("secret", "api-key = '{9aF3kL8mQ2xR7vB5nT1wY6zC4dH0jG}'"),
    ("iban", "Meine IBAN lautet {DE89 3704 0044 0532 0130 00} danke"),
    ("iban", "virement sur {FR1420041010050500013702606} merci"),
    ("iban", "my account: {GB82 WEST 1234 5698 7654 32}"),
    ("national_id", "The social security number {219-09-9999} was printed"),
    ("national_id", "mi DNI es {12345678Z} y vivo"),
    ("address", "she lives at {742 Evergreen Road} now"),
    ("address", "er wohnt {Lindenstraße 14} seit"),
    ("email", "mail anna.k {at} not here"),
    (None, "commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixes it"),
    (None, "sha1 checksum 9fceb02d0ae598e95dc970b74767f19372d61af8 ok"),
    (None, "the password: strictly confidential matters"),
    (None, "order no. ES9121000418450200051330 is late"),
    (None, "part number 219-09-9999 in the catalogue"),
    (None, "key: value pairs, a = 12345678, and so on"),
    (None, "Licensed under CC BY-NC 4.0. version 3."),
    (None, "the auth: module.login() call"),
]


def test_recall_and_precision_on_written_texts():
    model = P.fit_model(corpus(), P.PiiOptions())
    hit, wanted, wrong = {}, {}, []
    for kind, text in WRITTEN:
        plain = text.replace("{", "").replace("}", "")
        got = [(k, s, e) for s, k, e, f in model.select(plain) if f != "base"]
        if kind is None:
            wrong += [(plain, g) for g in got]
        elif kind != "email":
            start = text.index("{")
            wanted[kind] = wanted.get(kind, 0) + 1
            hit[kind] = hit.get(kind, 0) + ((kind, start, text.index("}") - 1) in got)
    assert not wrong
    # nine of twelve
    assert all(hit[k] >= 0.5 * n for k, n in wanted.items()) and sum(hit.values()) >= 0.7 * sum(wanted.values()), (hit, wanted)
    assert hit["secret"] == wanted["secret"]


def walk(trees, row):
    """A row's probability, by one walk down each tree."""
    total = trees.bias
    for tree in trees.trees:
        at = 0
        while tree[at][0] >= 0:
            f, cut, left, right = tree[at]
            at = left if row[f] <= cut else right
        total += tree[at][1]
    return 1 / (1 + np.exp(-total))


def test_spans_against_brute_force(spark):
    texts = [*corpus()[:80], *(t.replace("{", "").replace("}", "") for _, t in WRITTEN), *cases()[:11], *cases()[20:120]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = P.fit_model(corpus(), P.PiiOptions())
    got = {r.doc_id: r for r in P.pii_spans(docs, model).collect()}
    some = 0
    for i, text in enumerate(texts):
        text = text or ""
        chosen = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in brute(text).split(",") if x)]
        rest = [(walk(model.trees, P.features(text, s, e, k)), s, k, e, f) for s, k, e, f in P.candidates(text) if f in model.thresholds]
        for p, s, k, e, f in sorted(rest, key=lambda c: (-c[0], c[1:])):
            if p >= model.thresholds[f] and not any(s < b and a < e for a, _, b in chosen):
                chosen.append((s, k, e))
                some += 1
        chosen.sort(key=lambda c: (c[0], P.KINDS.index(c[1]), c[2]))
        assert got[i].spans == ",".join(f"{k}:{s}:{e}" for s, k, e in chosen), text
    assert some >= 8


def test_checks_of_numbers():
    from signalmill.llm import pii_forms as forms

    assert forms.iban_ok("DE89 3704 0044 0532 0130 00") and not forms.iban_ok("DE88370400440532013000")
    assert forms.id_ok("12345678Z") and not forms.id_ok("12345678A") and forms.id_ok("2 55 08 14 168 025 38")


def test_held_out_accuracy():
    texts = corpus()
    x, y, _, _ = P.training_rows(texts[:200])
    trees = P.BoostedTrees().fit(x, y)
    x, y, _, _ = P.training_rows(texts[200:], each=0)
    assert np.mean((trees.score(x) > 0.5) == y) > 0.97


def test_on_spark(spark):
    rows = [(i, t, "z") for i, t in enumerate([*cases()[:60], *corpus()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    model = P.train(docs)
    got = {r.doc_id: r for r in P.pii_spans(docs, model).collect()}
    for i, text, _ in rows:
        assert got[i].base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest()
        assert set(filter(None, brute(text).split(","))) <= set(got[i].spans.split(","))
    clean = P.redact(docs, model)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and texts[9] == "[PHONE], [IP]"
    none = docs.limit(0)
    assert P.pii_spans(none, P.train(none)).count() == 0


def test_redaction_of_overlaps():
    assert P.redacted("ab 12345 cd", [(3, "card", 6), (5, "phone", 8)]) == "ab [CARD] cd"


def test_sample_is_of_documents_with_candidates(spark, monkeypatch):
    texts = [f"{t} {i}" for i, t in enumerate(corpus())]
    rows = [(i, texts[i // 20] if i % 20 == 0 else f"nothing but the {i} words") for i in range(20 * len(texts))]
    drawn = []
    monkeypatch.setattr(P, "fit_model", lambda texts, options: drawn.append(texts))
    for parts in (3, 7):
        P.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), options=P.PiiOptions(sample_docs=1000))
        P.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), options=P.PiiOptions(sample_docs=100))
    all3, some3, all7, some7 = drawn
    assert sorted(all3) == sorted(texts) and all3 == all7
    assert len(some3) == 100 and some3 == some7 and set(some3) <= set(texts)
    # a rare kind has its share
    rare = [(i, f"write to a{i}@b.example.com") for i in range(4000)] + [(i, f"call +1 (555) 234-{i}") for i in range(4000, 4020)]
    P.train(spark.createDataFrame(rare, "doc_id long, text string"), options=P.PiiOptions(sample_docs=400))
    assert sum("call" in t for t in drawn[-1]) >= 10 and len(drawn[-1]) <= 400
    for text in cases() + corpus():
        if len(text or "") <= 20_000 and any(f in ("base", "failing") for *_, f in P.candidates(text or "")):
            assert any(P.re.search(p, text) for p in P._HOLDS.values()), text


def test_a_long_secret_goes_whole_and_many_colons_cost_little():
    import string
    import time

    rnd = random.Random(3)
    model = P.fit_model(corpus(), P.PiiOptions())
    for n in (40, 199, 201, 500, 5000):
        secret = "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
        text = f'The config has api_key = "{secret}", and more text follows.'
        start = text.index(secret)
        assert (start, "secret", start + n, "assigned") in P.candidates(text)
        left = P.redacted(text, sorted((s, k, e) for s, k, e, _ in model.select(text)))
        assert not any(secret[i : i + 12] in left for i in range(0, n - 12, 7)), (n, left[:200])
    began = time.process_time()
    P.candidates("token x:" + "a:" * 100_000)
    assert time.process_time() - began < 20
