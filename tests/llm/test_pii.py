import hashlib
import math
import random
import re

from wordloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def slow(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(k, m[0])]
    return sorted(found)


def test_base_spans(texts):
    rng = random.Random(3)
    parts = ["a", "1", "2", "55", "255", "256", ".", "@", "-", " ", "+", "(", ")", "_", "é", "😀", "4111 1111 1111 1111", "\n", "%", "0049"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    given += [None, "", "a@b.c" * 300, "x" * 3000 + "a@b.co", "1.2.3.4 " * 200, "+491234567890 a@b.co 4111111111111111"]
    found = {r.doc_id: r for r in pii.digest(pii.find_private(texts(list(enumerate(given))))).collect()}
    for i, text in enumerate(given):
        spans = slow(text)
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == [s for s in joined.split(",") if s]


def test_long_runs_do_not_overflow_or_crawl(texts):
    given = ["1" * 200_000, "a" * 200_000, "1 " * 80_000, "+1" + "(" * 100_000, "a.b@" * 40_000, "1." * 80_000]
    assert pii.find_private(texts(list(enumerate(given)))).count() == len(given)


def story():
    rng = random.Random(6)
    fill = lambda: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(12))
    data = [(i, fill()) for i in range(60)]
    data += [(100, f"{fill()} Mister Quillon writes from quillon@mail.org {fill()}"), (101, f"{fill()} ask Quillon by quillon@mail.org {fill()}"),
             (102, f"{fill()} Quillon, quillon@mail.org. {fill()} And QUILLON again."), (103, f"{fill()} other@mail.org {fill()}")]
    copied = f"{fill()} Vexley has vexley@mail.org {fill()}"
    return data + [(110, copied), (111, copied), (112, copied)]


def test_terms_that_reveal_an_entity(texts):
    data = dict(story())
    found = {r.doc_id: r for r in pii.digest(pii.find_private(texts(list(data.items())))).collect()}
    shown = {i: [data[i][int(a):int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"] for i, r in found.items()}
    assert "Quillon" in shown[100] and "Quillon" in shown[101]
    assert [t for t in shown[102] if t.lower() == "quillon"] == ["Quillon", "QUILLON"]
    assert not any(shown[i] for i in range(60)) and not shown[103]
    assert not any(shown[i] for i in (110, 111, 112))  # one text, however often copied, is one text


def test_terms_as_brute_force(texts):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(120)]
    mails = [f"q{i}@x{i}.yy" for i in range(12)]
    given = []
    for i in range(300):
        words = [vocabulary[min(int(rng.expovariate(0.03)), 119)] for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.4:
            e = min(int(rng.expovariate(0.4)), 11)
            words[rng.randint(0, len(words)):0] = [mails[e]] + [f"owner{'abcdefghijkl'[e]}"] * (rng.random() < 0.8)
        given.append((i, " ".join(words)))
    given += [(500 + i, given[7 * i][1]) for i in range(40)] + [(600, None), (601, "")]  # copies weigh nothing
    private = {t: {m[0].lower() for m in re.finditer(PLAIN["email"], t)} for _, t in given if t}
    terms = {t: set(re.findall(r"[^\W\d_]{3,}", t.lower())) for t in private}
    n = math.log(len(terms) + 2)
    df = lambda which, x: sum(x in v for v in which.values())
    told = {}
    for e in set().union(*private.values()):
        holders = [t for t in private if e in private[t]]
        own = n - math.log(len(holders))
        for w in set().union(*(terms[t] for t in holders)):
            co = sum(w in terms[t] for t in holders)
            shared = n + math.log(co) - math.log(df(terms, w)) - math.log(len(holders))
            if co >= 2 and co * own >= n and shared >= 0.8 * own:
                told.setdefault(e, set()).add(w)
    assert sum(map(len, told.values())) > 8
    for r in pii.digest(pii.find_private(texts(given))).collect():
        text = dict(given)[r.doc_id] or ""
        want = set().union(*(told.get(e, set()) & terms[text] for e in private.get(text, ())))
        base = [(a, b) for a, _, b in slow(text)]
        spans = [m.span() for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in want]
        spans = [f"term:{a}:{b}" for a, b in spans if not any(x < b and a < y for x, y in base)]
        assert [x for x in r.spans.split(",") if x.startswith("term")] == spans


def test_sanitise(texts, spark):
    data = [*story(), (200, "Mail a@b.co or 1.2.3.4, call +49 30 1234567."), (201, None), (202, ""), (None, "x@y.zz"), (203, "x@y.zz"), (203, "x@y.zz"),
            (203, "plain"), (204, "call +4222222222222 now")]
    given = texts(data)
    found = pii.sanitise(given)
    assert found.columns == given.columns
    out = {}
    for r in found.collect():
        out.setdefault(r.doc_id, []).append(r.text)
    assert len(sum(out.values(), [])) == len(data)
    assert out[200] == ["Mail [EMAIL] or [IP], call [PHONE]."] and out[201] == [None] and out[202] == [""]
    assert out[None] == ["[EMAIL]"] and sorted(out[203]) == ["[EMAIL]", "[EMAIL]", "plain"]
    assert "quillon" not in "".join(out[102]).lower() and "[TERM]" in out[100][0] and out[0] == [dict(data)[0]]
    assert out[204] == ["call [PHONE] now"]  # the card number inside is part of it
    assert pii.find_private(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
