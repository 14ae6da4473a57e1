"""Personal data and disclosing terms against a plain version with the plain patterns."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import regex

from ringweave.llm import disclosure as D
from tests.llm.conftest import rows_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
L = r"[\p{L}\p{M}]"


def good(kind, found):
    number = regex.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
        return 14 <= len(number) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 10 <= len(number) <= 15


def finds(text):
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        cuts = [m.span() for m in regex.finditer(pattern, text)]
        for k, (a, b) in enumerate(cuts):
            if not good(kind, text[a:b]):
                continue
            before = text[cuts[k - 1][1] if k else 0 : a]
            after = text[b : cuts[k + 1][0] if k + 1 < len(cuts) else len(text)]
            left = regex.sub(f"^{L}+", "", before[-D.NEAR - 1 :]) if len(before) > D.NEAR else before
            right = regex.sub(f"{L}+$", "", after[: D.NEAR + 1]) if len(after) > D.NEAR else after
            near = regex.sub(PLAIN["email"], " ", f"{left} {right}").lower()
            value = text[a:b].lower() if no == 0 else text[a:b] if no == 1 else regex.sub("[^0-9]", "", text[a:b])
            yield a, no, b, (no, value), set(regex.findall(L + "{3,}", near))


def brute(texts):
    found = [list(finds(t)) for t in texts]
    n_entity, n_term, n_both, kinds = Counter(), Counter(), Counter(), defaultdict(set)
    near = []
    for text, fs in zip(texts, found, strict=True):
        pairs = {(e, t) for *_, e, ts in fs for t in ts}
        near.append(pairs)
        n_entity.update({e for *_, e, _ in fs})
        n_both.update(pairs)
        for p in pairs:
            kinds[p].add(text)
        n_term.update(set(regex.findall(L + "{3,}", regex.sub(PLAIN["email"], " ", text).lower())))
    n, out = len(texts), []
    for text, fs, pairs in zip(texts, found, near, strict=True):
        share = {}
        for e, t in pairs:
            if len(kinds[e, t]) >= D.LEAST_TEXTS and n_entity[e] < n:
                s = math.log2(n * n_both[e, t] / n_entity[e] / n_term[t]) / math.log2(n / n_entity[e])
                share[t] = max(share.get(t, 0), s)
        spans = [(a, no, b) for a, no, b, *_ in fs]
        taken = [m.span() for m in regex.finditer(PLAIN["email"], text)]
        for m in regex.finditer(L + "+", text):
            s = share.get(m[0].lower(), 0)
            if s >= D.GENERALISE and not any(a < m.end() and m.start() < b for a, b in taken):
                spans.append((m.start(), 5 if s >= D.REMOVE else 4, m.end()))
        out.append(sorted(spans))
    return out


def text_of(spans):
    return ",".join(f"{D.NAMES[k]}:{a}:{b}" for a, k, b in spans)


def corpus():
    r = np.random.default_rng(11)
    words = ["the", "house", "Éclair", "und", "наука", "zwölf", "of", "stone", "river", "quiet"]
    people = [("Zara Quill", "zara.q@mail.example.org"), ("Tom Ash", "+1 (743) 555-3824"), ("Ida", "4785-3805 9239 1139"), ("Noor Vale", "152.143.123.131")]
    texts = []
    for i in range(200):
        body = [str(r.choice(words)) for _ in range(int(r.integers(5, 80)))]
        if i % 4 == 0:
            name, what = people[(i // 4) % 4]
            at = int(r.integers(len(body)))
            body[at:at] = [name, "writes", what + ",", name.split()[0].upper()] if i % 8 else [what]
            body.insert(0, name.split()[0])
        texts.append(" ".join(body))
    return texts + [texts[4]] * 5


def test_spans_equal_plain_version(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(s.start, s.kind, s.stop) for s in r.spans] for r in D.spans_of(df).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want))
    assert {k for spans in want for _, k, _ in spans} >= {0, 1, 2, 3, 5}


HARD = [
    "a@b.c%d@e.f x@y @z.q a@b@c.d é1a.b+c@d-e.f..g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 9.9.9", "4785 3805-9239 1139 47853805923911394785380592391139 1 2 - 3",
    "+1 (743) 555-3824 +12 +1234567890123456 ++49 30 1234567)-( x+4930.1234567.8.", "+1 743 555 3824 4785380592391139 1.2.3.4@x.de", "", " ", "😀 a@b.co 日本 +1 743 555 38 24 😀1.1.1.1",
    "a." * 3000 + "@" + "b." * 3000 + "c", "1" * 20_000, "a" * 30_000, "1 " * 20_000, "1." * 9_000, "+" * 5000 + "1" + "." * 5000, "x@" * 5000, "+1" + " (" * 9000 + "5", "%" * 20_000,
]


def test_hard_texts_equal_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.stop) for s in r.spans] for r in D.spans_of(df).collect()}
    assert got == dict(enumerate(brute(HARD)))


def test_sanitised_texts(spark):
    texts = corpus()
    found = {r.doc_id: r for r in D.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for s in found[i].spans:
            if s.start >= at:
                out += text[at : s.start] + f"<{D.NAMES[s.kind]}>"
            at = max(at, s.stop)
        assert found[i].text == out + text[at:]
    assert not any("zara" in r.text.lower() or "zara.q" in r.text for i, r in found.items() if r.spans and any(s.kind == 0 for s in r.spans) and i % 8)
    assert found[1].text == texts[1]


def test_odd_documents(spark, odd_docs, no_docs):
    found = D.spans_of(odd_docs).collect()
    assert len(found) == odd_docs.count() and all(r.spans == [] for r in found)
    assert rows_of(D.spans_of(no_docs)) == [] == rows_of(D.sanitised(no_docs))
    same = spark.createDataFrame([(None, "mail a@b.co"), (None, "mail a@b.co"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.spans)) for r in D.spans_of(same).collect()) == [(0, 1), (0, 1), (7, 0)]


def test_query_digests(spark, tmp_path):
    texts = corpus() + HARD
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in D.op11(spark, str(tmp_path)).collect()}
    for i, spans in enumerate(brute(texts)):
        base = [s for s in spans if s[1] < 4]
        n = Counter(s[1] for s in base)
        want = (*(n[k] for k in range(4)), hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans))
        assert tuple(rows[i])[1:] == want
