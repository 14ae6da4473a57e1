"""Extraction, mixing, languages, near copies, scoring and the pipeline."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ringweave.llm import html_extract, langid, maxent_lm, mixing, simhash
from ringweave.llm.common import components
from tests.llm.conftest import SF, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# extraction


@pytest.fixture(scope="module")
def field():
    return html_extract.trained(400)


def test_held_out_labelled_pages(field):
    pages = list(html_extract.labelled_pages(200, 99))
    found = field.decode([[field.rows(b.features) for b in blocks] for blocks, _ in pages])
    right = sum(int((f == np.array(y)).sum()) for f, (_, y) in zip(found, pages, strict=True))
    assert right / sum(len(y) for _, y in pages) > 0.98


def test_viterbi_equals_trying_all(field):
    from itertools import product

    pages = [[field.rows(b.features) for b in blocks] for blocks, _ in html_extract.labelled_pages(30, 5) if len(blocks) <= 9]
    for rows, found in zip(pages, field.decode(pages), strict=True):
        e = field.emissions(rows)

        def value(ys, e=e):
            return field.first[ys[0]] + sum(e[i, y] for i, y in enumerate(ys)) + sum(field.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))

        assert value(found.tolist()) == pytest.approx(max(map(value, product((0, 1), repeat=len(rows)))))


def test_given_pages_give_their_article(spark):
    found = html_extract.main_text(spark.read.parquet(f"{SF}/pages.parquet"))
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in found.collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        lines = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_odd_pages(spark, field):
    rows = [
        (1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "<script>x</script><style>p{}</style>"), (None, "u", "<p>a < b &amp; c&nbsp;d</p><p>unended <a hre"),
        (4, "u", "<article><h1>T &lt;1&gt;</h1><p>one<br>two\n  three</p><ul><li>x <b>y</b></ul><div class='comments'><p>me too</p></div></article><footer>f</footer>"),
        (5, "u", "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"), (6, "u", "<div>" * 5000 + "<p>deep text here, all of it.</p>"), (7, "u", "<p a=\"" + "<b>" * 50),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = {(r[0], r[1]): r[2:] for r in rows_of(html_extract.main_text(df, field))}
    assert found[1, "u"] == ("", 0) and found[2, None] == ("", 0) and found[3, "u"] == ("", 0)
    assert found[None, "u"][0] == "a < b & c d\nunended"
    assert found[4, "u"][0] == "T <1>\none two three\nx y"
    assert found[5, "u"][0] == "\n".join(["word word word."] * 20_000)
    assert rows_of(html_extract.main_text(df.limit(0), field)) == []


@pytest.mark.parametrize(
    "icon",
    [
        '<svg class="i"/>', "<math/>", '<SVG viewBox="0 0 1 1" />', "<svg><svg><path d='M0'/></svg><text>no</text></svg>", "<svg><title>no</title><style/><g/></svg>",
        "<svg><foreignObject><p>no</p></foreignObject></svg>", "<svg><!-- </svg> --><text>no</text></svg>", "<math><mi>no</mi></math>", '<svg data-a="</svg>"><text>no</text></svg>', "<svg><path>",
    ],
)
def test_icons_lose_nothing_else(icon):
    page = f"<article><p>first</p>{icon}<p>second {icon.replace('<svg><path>', '')}part</p><p>third</p></article>"
    assert [b.text for b in html_extract.blocks_of(page)] == ["first", "second part", "third"]


def test_long_attributes_and_deep_elements_keep_their_features():
    long = "x" * 3000
    page = f'<div data-a="hidden class=no {long}" class="comments" style="{"a:b;" * 300}display:none"><p>me too</p></div><p title="hidden {long}">open</p>'
    closed, free = (b.features for b in html_extract.blocks_of(page))
    assert "name comments" in closed and "hidden" in closed and "name no" not in closed
    assert not {"name comments", "hidden"} & set(free)
    deep = "<div>" * 300 + '<section class="comments"><p>one</p></section><p>two</p>' + "</div>" * 299 + "<p>three</p></div><p>four</p>"
    one, two, three, four = (set(b.features) for b in html_extract.blocks_of(deep))
    assert {"in section", "name comments"} <= one and "name comments" not in two | three
    assert "in div" in two & three and "in div" not in four


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, free = total - 3 * sum(sizes[s] for s in full), [s for s in names if s not in full]
        goal = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else goal[s] for s in names}
        full |= over


@pytest.mark.parametrize("skew", [False, True])
def test_targets_and_takings(spark, docs, skew):
    df = docs
    if skew:
        df = docs.selectExpr("doc_id", "text", "lang", "n_chars", "CASE WHEN doc_id % 3 > 0 THEN 'src0' WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source")
    text = {r.doc_id: r for r in df.collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in text.items()}
    sums = Counter()
    for i, r in text.items():
        sums[r.source] += size[i]
    goal, taken = brute_targets(sums), Counter()
    for r in mixing.Mix(df, shards=5).per_document().collect():
        source = text[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], sums[source])
        assert r.target == pytest.approx(goal[source]) and 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_tree_shares_add_up():
    quotas = np.array([5, 0, 1000, 37])
    parts = [mixing.split(quotas, 7, s, 3) for s in range(7)]
    assert (np.sum(parts, axis=0) == quotas).all()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 3


def test_blocks_are_drawn_once_a_pass(docs):
    mix = mixing.Mix(docs, shards=3)
    rows = rows_of(mix.rows.select("row", "pass", "shard"))
    assert len({r[:2] for r in rows}) == len(rows) and {r[2] for r in rows} == {0, 1, 2}
    assert sorted(rows) == sorted(rows_of(mixing.Mix(docs, shards=3).rows.select("row", "pass", "shard")))


JUNK = [
    'div class="comments"', 'div class="user-comments"', 'ol class="comment-list"', 'section id="comments"', 'div class="ad-slot"', 'div class="advert"', "div hidden", 'div style="display:none"',
    'div aria-hidden="true"', "aside", "nav", "footer", "form", 'div class="share-buttons"', 'div class="newsletter-signup"', 'div id="cookie-notice"',
]
REAL = [
    "The council met on Tuesday to hear the plans for the old harbour, which has stood empty since the last ferry left.",
    "Residents asked how long the works would take and who would pay for them; the answers came slowly.",
    "A second meeting is planned for the spring, when the first drawings should be ready.",
]
NOISE = ["I was there and it was nothing like this, the whole thing took ten minutes.", "Great read, thank you for sharing this with all of us here today.", "Why does nobody ever ask the people who live on the quay about it?"]


@pytest.mark.parametrize("frame", ["<article>{}</article>", '<div class="post-content">{}</div>', "<main><div>{}</div></main>"])
@pytest.mark.parametrize("inside", [True, False])
def test_hand_written_pages_lose_their_junk(frame, inside):
    """Layouts that the generator does not make: three lines of junk between real paragraphs or after the article."""
    field, kept = html_extract.trained(), []
    for junk in JUNK:
        tag = junk.split()[0]
        lines = "".join(f"<li>{x}</li>" if tag == "ol" else f"<p>{x}</p>" for x in NOISE)
        block, real = f"<{junk}>{lines}</{tag}>", [f"<p>{x}</p>" for x in REAL]
        body = frame.format(f"<h1>The old harbour</h1>{real[0]}{real[1]}{block}{real[2]}") if inside else frame.format("<h1>The old harbour</h1>" + "".join(real)) + block
        page = f'<html><head><title>t</title></head><body><header><a href="/">Daily</a></header>{body}<footer>&copy; 2026 Daily</footer></body></html>'
        if html_extract.main_texts(field, [page])[0] != "\n".join(["The old harbour", *REAL]):
            kept.append(junk)
    assert kept == []


def test_mixed_texts_are_whole(docs):
    mix = mixing.Mix(docs, shards=3, keep_text=True)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = Counter()
    for r in mix.rows.collect():
        want[r.doc_id] += 2 * r.words >= len(WORD.findall(texts[r.doc_id]))
    found = mix.mixed_documents().collect()
    assert Counter(r.doc_id for r in found) == +want
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in found)


def test_mixing_odd_documents(odd_docs, no_docs):
    found = rows_of(mixing.Mix(odd_docs).per_document())
    assert len(found) == odd_docs.count()
    assert all(t == 0 for _, n, _, _, t in found if n == 0)
    assert rows_of(mixing.Mix(no_docs).per_document()) == [] and rows_of(mixing.Mix(no_docs, keep_text=True).mixed_documents()) == []


# languages


def test_probabilities_add_up():
    words = {"en": Counter("the then this that hat at a".split()), "de": Counter("der die das dass und hund".split())}
    model = langid.Model.fit({k: langid.gram_rows(list(v), list(v.values())) for k, v in words.items()})
    letters = sorted({c for v in words.values() for w in v for c in w} | {" "})
    for start in ("", "t", "th", "hun", "zz"):
        def bits(word):
            return model.score_words([word])[0][0]

        # the bits of a word minus those of its opening, for each next character
        whole = []
        for c in letters:
            longer = langid.Encoded.of([start + c.strip()])
            n = len(start) + 1
            longer.codes, longer.room, longer.owner = longer.codes[: n + 1], longer.room[: n + 1], longer.owner[: n + 1]
            whole.append(sum_of(model, longer) - (sum_of(model, cut(longer, n)) if n > 1 else 0))
        assert np.exp2(np.array(whole)).sum(0) == pytest.approx([1 - 2**model.uniform] * 2, abs=0.12)


def cut(text, n):
    return langid.Encoded(text.codes[:n], text.room[:n], text.owner[:n])


def sum_of(model, text):
    original = langid.Encoded.of
    langid.Encoded.of = classmethod(lambda cls, words: text)
    try:
        return model.score_words([""])[0][0]
    finally:
        langid.Encoded.of = original


def test_held_out_languages(docs):
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predictions(docs.select("doc_id", "text", "lang"), model, keep=("doc_id", "lang")).withColumn("held", langid.held_out()).collect()
    held = [r for r in found if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found) and not any(r.rejected for r in found)


def test_odd_languages(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    found = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predictions(odd_docs.select("doc_id", "text"), model).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True), (None, "und", True)} <= found
    assert {p for d, p, _ in found if d in (1, 5)} == {"en"}
    assert rows_of(langid.predictions(no_docs, model)) == []
    nothing = langid.predictions(odd_docs, langid.train(no_docs)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_languages_of_few_texts_are_learned(spark):
    """One text a language: by chance an eighth of them would only calibrate."""
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} text", f"l{i}") for i in range(40)]
    rows += [(100, "repeated rows of one text", "r")] * 20 + [(200 + i, "many different texts here", "m") for i in range(64)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows})
    assert model.limit[0] < 99


# near copies


def brute_print(text, size=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(parts))


def brute_groups(prints):
    label = {p: p for p in prints}
    while True:
        new = {p: min(label[q] for q in prints if (p ^ q).bit_count() <= 4) for p in prints}
        if new == label:
            return label
        label = new


def test_golay_keys_cover_one_error():
    words = simhash.golay_words()
    assert min(int(w).bit_count() for w in words[1:]) == 7
    table = simhash.golay_keys()
    for bit in range(16):
        other = table[np.arange(1 << 16) ^ (1 << bit)]
        assert (table[:, :1] == other).any(1).all()


def test_every_link_has_a_key(spark):
    """Random fingerprints with up to four errors, spread over segments in all ways, and chains of them."""
    r = np.random.default_rng(2)
    prints = []
    for base in r.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        prints.append(base)
        for _ in range(12):
            base = prints[-1] if r.random() < 0.3 else base
            prints.append(base ^ sum(1 << b for b in r.choice(64, r.integers(1, 5), replace=False).tolist()))
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = dict(rows_of(simhash.roots(df)))
    want = brute_groups([p & (2**64 - 1) for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(found[p], set()).add(want[p & (2**64 - 1)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_keys_of_fingerprints_are_not_broadcast(spark):
    """A table below the broadcast limit gives many times as many keys, which Spark does not foresee."""
    first = spark.range(3000).select(F.col("id").alias("fp"), F.col("id").alias("root"))
    exact = first.select("fp", "root", F.explode(simhash.exact_keys(F.col("fp"))).alias("key"))
    table = simhash.golay_keys()
    for left, right in ((exact, exact), (simhash.fuzzy_rows(first, False, table), simhash.fuzzy_rows(first, True, table))):
        assert "Broadcast" not in simhash._across(left, right)._jdf.queryExecution().executedPlan().toString()


def test_near_copies_of_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    prints = [brute_print(r.text) for r in rows]
    label = brute_groups(set(prints))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints, strict=True)]
    assert sorted(rows_of(simhash.near_duplicates(odd_docs)), key=str) == sorted(want, key=str)
    assert rows_of(simhash.near_duplicates(no_docs)) == []
    assert simhash.one_of_each(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")).count() == len(set(label.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = dict(rows_of(components(edges)))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# scoring


def test_scores_against_brute_force(docs, monkeypatch):
    counts, end = Counter(), object()
    rows = docs.collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update(maxent_lm.tokens_of(r.text))
            counts[end] += 1
    n, v = sum(counts.values()), len(counts)
    language, table = maxent_lm.learn(docs.where(~maxent_lm.held_out()), frequent=500)  # most words go by the join
    found = {r.doc_id: r for r in maxent_lm.scores(docs, language, table).collect()}
    gain = []
    for r in rows:
        tokens, got = [*maxent_lm.tokens_of(r.text), end], found[r.doc_id]
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert got.base_score == pytest.approx(base)
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 1:
            gain.append(got.score - base)
    assert sum(gain) > 0  # the model tells held-out texts better than the frequencies do
    # within classes and over classes everything adds up to one
    z = language.logits(np.zeros((4, 1), np.uint16))
    assert np.exp(z - np.log(np.exp(z).sum())).sum() == pytest.approx(1, abs=1e-5)
    mass = Counter()
    for w, c in counts.items():
        k = 0 if w is end else int(language.classes[maxent_lm.bucket_of(w)])
        mass[k] += (c + 0.5) / 10 ** language.class_log[k]
    assert all(m + 0.5 / 10 ** language.class_log[k] == pytest.approx(1) for k, m in mass.items())


def test_words_of_many_texts():
    texts = [None, "", " \t", " a  B\x0b\x0cc\x85d\u00a0e\x1cf ", "x\x00y a", "É é \n a", "w " * 5000]
    own, at, sizes = maxent_lm.words_of(texts)
    want = [maxent_lm.tokens_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [own[i] for i in at] == [w for s in want for w in s]
    assert len(set(own)) == len(own) and maxent_lm.words_of([])[2].tolist() == []


def test_slopes_by_row():
    random = np.random.default_rng(8)
    rows = np.minimum(random.zipf(1.3, (4, 3000)), 40_000).astype(np.int64)  # one row holds about a quarter
    slope = random.normal(size=(3000, 5)).astype(np.float32)
    want = np.zeros((40_001, 5))
    for r in rows:
        np.add.at(want, r, slope)
    which, sums = maxent_lm.sums_by_row(rows, slope)
    assert sorted(which) == sorted(set(rows.ravel().tolist())) and np.allclose(want[which], sums, atol=1e-3)


def test_features_grow_with_the_corpus(docs, monkeypatch):
    assert [maxent_lm.rows_for(n) for n in (0, 10**6, 10**8, 10**12)] == [1 << 15, 1 << 15, 1 << 17, 1 << 18]
    monkeypatch.setattr(maxent_lm, "MIN_ROWS", 1 << 10)
    few, many = docs.repartition(5, "doc_id"), {}
    for tokens_a_row, fan_in in ((1 << 40, 256), (4, 256), (4, 2)):
        monkeypatch.setattr(maxent_lm, "TOKENS_A_ROW", tokens_a_row)
        monkeypatch.setattr(maxent_lm, "FAN_IN", fan_in)
        language, _ = maxent_lm.learn(few)
        many[tokens_a_row, fan_in] = language.weights
        assert len(language.weights) == maxent_lm.rows_for(language.n)
    assert len(many[1 << 40, 256]) == 1 << 10 < len(many[4, 256])
    assert np.allclose(many[4, 256], many[4, 2], atol=1e-4)  # the tree of averages is the average


def test_scores_of_odd_documents(odd_docs, no_docs):
    language, table = maxent_lm.learn(odd_docs)
    found = rows_of(maxent_lm.scores(odd_docs, language, table))
    assert len(found) == odd_docs.count() and all(math.isfinite(r[4]) and math.isfinite(r[5]) for r in found)
    assert {r[1] for r in found if r[0] in (2, 3, 4)} == {1}
    assert rows_of(maxent_lm.scores(no_docs, language, table)) == []
    nothing, none = maxent_lm.learn(no_docs)
    blank = rows_of(maxent_lm.scores(odd_docs, nothing, none))
    assert {(r[2], r[3]) for r in blank} == {(0, 0)} and all(r[4] == pytest.approx(0, abs=1e-6) for r in blank)


# pipeline


def test_pipeline_stages(spark, docs):
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, SF)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        before, after = kept.collect(), out.collect()
        if name == "language_id":
            assert sorted(after) == sorted(r for r in before if regex.search(r"\p{L}", r.text or ""))
        if name == "simhash_near_dedup":
            prints = {r.doc_id: brute_print(r.text, 5) for r in before}
            label = brute_groups(set(prints.values()))
            least = {}
            for i, p in prints.items():
                least[label[p]] = min(least.get(label[p], i), i)
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        if name == "mixing_sources":
            sums, taken = Counter(), Counter()
            for r in before:
                sums[r.source] += len(WORD.findall(r.text or ""))
            for r in after:
                taken[r.source] += len(WORD.findall(r.text))
            goal = brute_targets(sums)
            most = {s: max(len(WORD.findall(r.text or "")) for r in before if r.source == s) for s in goal}  # the last one is there or not
            assert all(abs(taken[s] - goal[s]) <= most[s] / 2 + 0.5 for s in goal)
        kept = spark.createDataFrame(after, out.schema)
    ids = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in ids) == sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string, source string")
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² 123", "①②", "Ⅷ ⅷ", "́", "_ 7_7", "the cat"])], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predictions(odd, langid.train(docs)).collect()}
    assert {found[i] for i in range(5)} == {("und", 0.0, True)} and found[5][0] == "en"


def test_registered_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_embedding_near_dedup", "op10_nearest_neighbours", "op11_pii_disclosure", "op12_conversation_trie"])
def test_queries_with_sql(spark, name):
    import __spark_entry__ as entry
    from tests.compare import connect, run_pair

    _, problem = run_pair(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
